"""URL functions as Column expressions. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, col, found, let, spaced

# Job boards and tracking parameters.
BOARDS = r"ashbyhq\.com|greenhouse\.io|lever\.co|myworkdayjobs\.com|workdayjobs\.com|smartrecruiters\.com|icims\.com|jobvite\.com|rippling\.com|boards\.eu"
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "source", "jobsite")

#: scheme, user information, host, port, path, query, fragment
SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#@]*\]|[^/?#:@\[]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

#: An address that is in its serialized form already: a plain host, a path of plain segments, a query of usual characters.
#: Without a query and a slash at its end it is in its canonical form too. Most addresses are, and cost one match.
PLAIN = r"\A{scheme}://[a-z0-9_.\-]++(?:/[A-Za-z0-9_~\-]++)++{more}\z"
SERIALIZED, CANONICAL = PLAIN.format(scheme="https?", more=r"/?(?:\?[A-Za-z0-9_~=&%.+\-]*+)?"), PLAIN.format(scheme="https", more="")

#: What separates the parts of a taken-apart address; no address holds it.
CUT = "\x01"


def parts_of(url: Text) -> Column:
    """The seven parts of an address, by one match; an array of another size if it has not that shape.

    The functions below take such parts in place of the address' own, so that a plan takes each address apart once.
    """
    return F.split(F.regexp_replace(F.trim(col(url)), SHAPE, CUT.join(f"${i}" for i in range(1, 8))), CUT)


def _get(parts: Column, n: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(n - 1)), F.lit(""))


def _host(parts: Column) -> Column:
    return F.when(F.size(parts) == 7, F.lower(_get(parts, 3))).otherwise("")


def _scheme(parts: Column) -> Column:
    return F.when(F.size(parts) == 7, F.lower(_get(parts, 1))).otherwise("")


def _valid(parts: Column) -> Column:
    return F.coalesce((F.size(parts) == 7) & _scheme(parts).isin("http", "https") & F.regexp_like(_host(parts), F.lit(r"^(?:[a-z0-9_.\-]+|\[[0-9a-f:.]+\])$")), F.lit(False))


def _path(parts: Column) -> Column:
    """The path with blanks escaped and its dot segments resolved."""
    raw = F.replace(_get(parts, 5), F.lit(" "), F.lit("%20"))
    steps = F.slice(F.split(raw, "/"), 2, F.size(F.split(raw, "/")))
    is_ = lambda s, *forms: F.lower(s).isin(*forms)
    here, up = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(is_(s, *here), done).when(is_(s, *up), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    resolved = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(is_(F.element_at(steps, -1), *here, *up) & (F.size(walked) > 0), "/").otherwise(""))
    return F.when(F.regexp_like(raw, F.lit(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")), resolved).otherwise(raw)


def _part(parts: Column, n: int) -> Column:
    return F.when(F.size(parts) == 7, _get(parts, n)).otherwise("")


def _port(parts: Column) -> Column:
    usual = F.concat(_scheme(parts), F.lit(":"), _get(parts, 4)).isin("http:", "https:", "http:80", "https:443")
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), _get(parts, 4)))


def _serialized(parts: Column) -> Column:
    user = F.when(_get(parts, 2) == "", "").otherwise(F.concat(_get(parts, 2), F.lit("@")))
    path = F.coalesce(F.nullif(_path(parts), F.lit("")), F.lit("/"))
    return F.when(_valid(parts), F.concat(_scheme(parts), F.lit("://"), user, _host(parts), _port(parts), path, _get(parts, 6), _get(parts, 7)))


def _plainly(url: Column, form: str, other: Column) -> Column:
    """The address where it has the form, else `other`."""
    return F.when(F.regexp_like(url, F.lit(form)), url).otherwise(other)


def part(url: Text, n: int) -> Column:
    """Part n, counted from 1; empty if there is none."""
    return _part(parts_of(url), n)


def scheme(url: Text) -> Column:
    return _scheme(parts_of(url))


def host(url: Text) -> Column:
    return _host(parts_of(url))


def host_of(parts: Column) -> Column:
    return _host(parts)


def valid(url: Text) -> Column:
    """A web address with a plain ASCII host."""
    return _valid(parts_of(url))


def serialized(url: Text) -> Column:
    """The address with lower-case scheme and host, without a default port, with at least "/" as path; null if not valid."""
    return _plainly(col(url), SERIALIZED, let(parts_of(url), _serialized))


def parameters(url: Text, parts: Column | None = None) -> Column:
    """array<struct<key, value>> of the query, decoded, in order."""
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.filter(F.split(F.substr(_part(parts_of(url) if parts is None else parts, 6), F.lit(2)), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), F.when(F.contains(p, F.lit("=")), decoded(F.substr(p, F.instr(p, F.lit("=")) + 1))).otherwise("").alias("value")))


def url_error(url: Text, parts: Column | None = None) -> Column:
    """Why there is no canonical form: invalid, not_https or credentials; null if there is one."""
    p = parts_of(url) if parts is None else parts
    return F.when(col(url).isNull(), F.lit(None)).when(~_valid(p), "invalid").when(_scheme(p) != "https", "not_https").when(_part(p, 2) != "", "credentials")


def canonical(url: Text, parts: Column | None = None) -> Column:
    """https only: lower-case host, no fragment, default port or tracking parameter, parameters sorted by name, no slash at the end."""
    return _plainly(col(url), CANONICAL, let(parts_of(url), lambda p: _canonical(url, p)) if parts is None else _canonical(url, parts))


def _canonical(url: Text, p: Column) -> Column:
    kept = F.filter(parameters(url, p), lambda q: ~(F.startswith(F.lower(q["key"]), F.lit("utm_")) | F.lower(q["key"]).isin(*TRACKING)))
    placed = F.transform(kept, lambda q, i: F.struct(q["key"].alias("key"), i.alias("i"), q["value"].alias("value")))
    query = F.array_join(F.transform(F.array_sort(placed), lambda q: F.concat(F.url_encode(q["key"]), F.lit("="), F.url_encode(q["value"]))), "&")
    path = let(F.regexp_replace(_path(p), "/+$", ""), lambda s: F.when(s == "", "/").otherwise(s))
    whole = F.concat(F.lit("https://"), _host(p), _port(p), path, F.when(_part(p, 6) == "", "").otherwise(let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))))
    return F.when(col(url).isNotNull() & url_error(url, p).isNull(), whole)


def segments(url: Text, parts: Column | None = None) -> Column:
    return F.array_remove(F.split(_part(parts_of(url) if parts is None else parts, 5), "/"), "")


def job_identity(url: Text, parts: Column | None = None) -> Column:
    """struct(board, id) of a canonical address, or null."""
    return let(parts_of(url), lambda p: _job_identity(url, p)) if parts is None else _job_identity(url, parts)


def _job_identity(url: Text, p: Column) -> Column:
    h, s, given = _host(p), segments(url, p), parameters(url, p)
    n, last = F.size(s), F.try_element_at(s, F.lit(-1))
    named = lambda name: F.get(F.filter(given, lambda q: q["key"] == name), F.lit(0))["value"]
    explicit = F.when(_part(p, 6) != "", F.coalesce(named("gh_jid"), named("job_id"), named("jobId")))
    pair = lambda board, i: F.struct(board.alias("board"), i.alias("id"))
    return (
        F.when(F.regexp_like(explicit, F.lit(r"^[A-Za-z0-9_\-]{3,128}$")), pair(h, explicit))
        .when((h == "jobs.lever.co") & (n >= 2), pair(F.lit("lever"), last))
        .when((h == "jobs.ashbyhq.com") & (n >= 2), pair(F.lit("ashby"), last))
        .when(h.isin("boards.greenhouse.io", "job-boards.greenhouse.io") & (n >= 2), pair(F.lit("greenhouse"), last))
        .when(h.endswith(".myworkdayjobs.com") & (n >= 1), pair(F.lit("workday"), last))
        .when(h.endswith(".rippling.com") & (n >= 3) & (F.get(s, F.lit(1)) == "jobs"), pair(F.lit("rippling"), F.get(s, F.lit(2))))
    )


def is_job_url(url: Text | None, variant: str = "relevance", parts: Column | None = None) -> Column:
    """A job board's host, a host named after jobs, or a path that leads to applications.

    The variant "relevance" also looks at the query; "enrichment" at host labels and the path alone.
    """
    return let(parts_of(url), lambda p: _is_job_url(p, variant)) if parts is None else _is_job_url(parts, variant)


def _is_job_url(p: Column, variant: str) -> Column:
    named = r"(?:^|\.)(?:ats|jobs|careers)\."
    where = F.lower(F.concat(_part(p, 5), _part(p, 6)) if variant == "relevance" else _part(p, 5))
    path = F.regexp_like(where, F.lit(r"/(?:jobs?|careers?|apply|application)(?:/|$|\?)"))
    return F.coalesce(_valid(p) & (F.regexp_like(_host(p), F.lit(rf"(?:^|\.)(?:{BOARDS})$|{named}")) | path), F.lit(False))


def literal_urls(text: Text) -> Column:
    """struct(literal, url) of each valid address in a text, in order: what the text says, and its serialized form."""
    raw = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0))
    said = F.transform(raw, lambda u: F.regexp_replace(u, r"[),.;!?]+$", ""))
    return F.filter(F.transform(said, lambda u: F.struct(u.alias("literal"), serialized(u).alias("url"))), lambda s: s["url"].isNotNull())


def with_attachments(urls: Column, attachments: Text | None) -> Column:
    more = F.transform(F.coalesce(col(attachments), F.array().cast("array<string>")), lambda u: serialized(u)) if attachments is not None else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(urls, more)))


def urls_in(text: Text, attachments: Text | None = None) -> Column:
    """Distinct serialized addresses of a text, in order, then those of attachments (an array of addresses)."""
    return with_attachments(F.transform(literal_urls(text), lambda s: s["url"]), attachments)


def cell_url(cell: Text) -> Column:
    """The address of a table cell: an anchor's, then a Markdown link's, then a bare one."""
    bare = F.regexp_replace(found(cell, r"https?://[^\s<>)|\"'\\]+"), "[.,;:]+$", "")
    return F.coalesce(found(cell, r"(?i)href\s*=\s*[\"'](https?://[^\"'\s]+)[\"']", 1), found(cell, r"\((https?://[^)\s]+)\)", 1), bare)


def observation_key(repository: Text, path: Text, row: Text, url: Text) -> Column:
    digest = F.sha2(F.concat_ws("\n", col(repository), col(path), spaced(row)), 256)
    return F.when(col(url).isNotNull(), F.concat(F.lit("url:"), col(url))).otherwise(F.concat(F.lit("row:"), digest))
