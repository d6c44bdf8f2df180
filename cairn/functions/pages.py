"""Job postings in web pages: JSON-LD first, then meta tags and headings, as Column expressions over the html.

JSON-LD is read as a variant, so a record's shape may differ from page to page. Lists and `@graph` lists within each
other are looked into DEPTH levels deep; `deep_postings` finds records at any depth, in Arrow batches.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Text, col, found, let, one_line, spaced, work_mode

LD = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
#: Entities that pages use in titles and prose, in the order in which they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
DEPTH = 5


def _numeric(text: Column, pattern: str, code) -> Column:
    """The text with its references of that pattern as characters; what names no character stays."""
    fits = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    character = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    shown = lambda r: F.coalesce(let(code(F.regexp_extract(r, "([0-9a-fA-F]+);", 1)), lambda n: F.when(fits(n), character(n))), r)
    references = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), F.aggregate(references(t), t, lambda done, r: F.replace(done, r, shown(r)))).otherwise(t))


def decoded(text: Text) -> Column:
    """Named entities, `&amp;` first (so that doubly escaped ones are decoded whole), then decimal and hexadecimal references."""
    named = reduce(lambda out, e: F.regexp_replace(out, f"(?i){e[0]}", e[1]), ENTITIES, col(text))
    decimal = _numeric(named, "&#[0-9]+;", lambda digits: digits.try_cast("bigint"))
    return _numeric(decimal, "(?i)&#x[0-9a-f]+;", lambda digits: F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).cast("bigint")))


def plain(html: Text) -> Column:
    """Text without scripts, styles and tags, in single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(html), r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " "), r"<[^>]+>", " ")
    return decoded(spaced(bare))


def meta(html: Text, name: str) -> Column:
    """Content of the first meta tag of that name or property, whichever order its attributes have."""
    key = rf"(?:property|name)=[\"']{name}[\"']"
    value = F.coalesce(found(html, rf"(?i)<meta[^>]+{key}[^>]+content=[\"']([^\"']+)[\"'][^>]*>", 1), found(html, rf"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+{key}[^>]*>", 1))
    return F.nullif(decoded(F.trim(value)), F.lit(""))


def heading(html: Text) -> Column:
    return F.nullif(plain(found(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit(""))


def title(html: Text) -> Column:
    return F.nullif(decoded(spaced(found(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))), F.lit(""))


def before_bar(text: Text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s*\|\s*.*$", ""))


def _string(value: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(value, path, "string")), F.lit(""))


def posting(html: Text) -> Column:
    """The first JSON-LD record of type JobPosting as a variant, or null; malformed blocks are passed over."""
    blocks = F.transform(F.regexp_extract_all(col(html), F.lit(LD), F.lit(1)), F.try_parse_json)
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def opened(v: Column, depth: int) -> Column:
        """The record and all within it, in the order in which they are looked at."""
        inner = F.concat(listed(v, "$"), listed(v, "$['@graph']"))
        return F.concat(F.array(v), F.flatten(F.transform(inner, lambda e: opened(e, depth - 1)))) if depth else F.array(v)

    records = F.flatten(F.transform(blocks, lambda b: opened(b, DEPTH)))
    kinds = lambda v: F.concat(F.array(F.try_variant_get(v, "$['@type']", "string")), F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array().cast("array<string>")))
    return F.get(F.filter(records, lambda v: F.coalesce(F.array_contains(F.array_compact(kinds(v)), "JobPosting"), F.lit(False))), F.lit(0))


def _place(v: Column) -> Column:
    """One location: its text, its name, its address in words or the parts of it ("City, ST" in the US)."""
    parts = F.array_compact(F.array(*(_string(v, f"$.address.{p}") for p in ("addressLocality", "addressRegion", "addressCountry"))))
    domestic = (F.size(parts) >= 2) & (F.upper(F.element_at(parts, -1)) == "US")
    joined = F.when(domestic, F.concat_ws(", ", F.slice(parts, 1, 2))).when(F.size(parts) > 0, F.concat_ws(", ", parts))
    flat = lambda path: F.when(F.regexp_like(F.try_variant_get(v, path, "string"), F.lit(r"^\s*[^\s{\[]")), _string(v, path))  # noqa: E731  an object isn't a text
    return F.coalesce(flat("$"), _string(v, "$.name"), flat("$.address"), joined)


def places(job: Column) -> Column:
    one = F.try_variant_get(job, "$.jobLocation", "variant")
    several = F.coalesce(F.try_variant_get(job, "$.jobLocation", "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))
    return F.array_distinct(F.array_compact(F.transform(several, _place)))


def job_page(html: Text, job: Column | None = None) -> Column:
    """struct(title, company, role, locations, description, posted, work_mode) of a page. job: its posting, if it is known."""
    job = posting(html) if job is None else job
    org = F.coalesce(_string(job, "$.hiringOrganization.name"), F.when(F.regexp_like(F.try_variant_get(job, "$.hiringOrganization", "string"), F.lit(r"^\s*[^\s{]")), _string(job, "$.hiringOrganization")))
    description = F.coalesce(F.nullif(F.substring(plain(F.try_variant_get(job, "$.description", "string")), 1, 2000), F.lit("")), meta(html, "og:description"), meta(html, "description"))
    role = F.coalesce(decoded(_string(job, "$.title")), before_bar(meta(html, "og:title")), heading(html), before_bar(title(html)))
    company = F.coalesce(org, F.regexp_replace(meta(html, "og:site_name"), r"\s+Recruiting$", ""))
    remote = F.regexp_like(F.try_variant_get(job, "$.jobLocationType", "string"), F.lit("(?i)telecommute"))
    where = F.coalesce(places(job), F.array().cast("array<string>"))
    mode = F.when(remote, "Remote").otherwise(work_mode(where, description))
    posted = F.try_to_timestamp(_string(job, "$.datePosted"))
    return F.struct(title(html).alias("title"), company.alias("company"), role.alias("role"), where.alias("locations"), description.alias("description"), posted.alias("posted"), mode.alias("work_mode"))


#: Fixed value: the first line of a page's snapshot.
HEADING = "Fetched job posting snapshot (trusted fetch):"


def snapshot(page: Column, url: Column, final_url: Column) -> Column:
    """A page's fields as labelled lines, which the labelled parser reads."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    where = F.when(F.size(page["locations"]) > 0, F.array_join(page["locations"], "; "))
    last = F.when(final_url != url, final_url)
    return F.concat_ws("\n", F.lit(HEADING), line("Company", page["company"]), line("Role", page["role"]), line("Location", where), line("Work mode", page["work_mode"]), line("Posted", F.date_format(page["posted"], "yyyy-MM-dd")), line("Excerpt", one_line(page["description"])), line("Description", page["description"]), url, last)


def deep_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with a column `job` (JSON text of the first JobPosting at any depth), in Arrow batches.

    For pages whose JSON-LD holds a JobPosting that `posting` doesn't reach.
    """

    def search(value):
        if isinstance(value, list):
            return next((hit for v in value if (hit := search(v))), None)
        if not isinstance(value, dict):
            return None
        kinds = value.get("@type")
        if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
            return value
        return search(value.get("@graph"))

    def work(batches):
        import re

        block = re.compile(LD)
        for batch in batches:
            jobs = []
            for source in batch[html]:
                hit = None
                for text in block.findall(source or ""):
                    try:
                        hit = search(json.loads(text))
                    except (ValueError, RecursionError):
                        continue
                    if hit:
                        break
                jobs.append(json.dumps(hit) if hit else None)
            yield batch.assign(job=jobs)

    return pages.drop("job").mapInPandas(work, T.StructType([*(f for f in pages.schema if f.name != "job"), T.StructField("job", T.StringType())]))
