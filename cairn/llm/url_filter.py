"""URL filter: host and path rules first, trust and distrust spread over the link graph for the rest; DataFrame operations only.

Hosts with pages that a rule allows send out trust along the links, hosts with pages that a rule blocks send distrust
against the links (who links to blocked hosts is suspect). Both are personalised PageRanks on the hosts' graph with the
damping given; what reaches a host without further links leaves the walk. Each round moves on what the last one
brought, until no host is new and no host's value changes by more than a small share of itself. A host whose distrust
exceeds its trust is blocked.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_share, cut_lineage, quoted, read

#: (allow or block, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: The share of a host's value by which a round's change is small; values closer than CLOSE, as a share, are equal.
TOLERANCE, CLOSE = 1e-4, 1e-9
#: Links of a host in one task; a host with more is dealt over several.
LINKS = 8192
#: After the scheme: host, path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute or scheme-relative link of an anchor.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def by_length(rules: Sequence[Rule]) -> list[Rule]:
    """Longest rule first; of equally long ones the first in code point order."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The rules become one expression in the scan's stage."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(by_length(rules)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target, n: the links between different hosts, counted."""
    linked = pages.select(host_of(F.col(url)).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("to"))
    return linked.select("source", lower(F.col("to")).alias("target")).filter("source <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, allowed, blocked: numbers of pages) and links (source, target, n).

    Trust (kind 0) goes from source to target, distrust (kind 1) the other way; both walks are one job a round. The
    rounds end: a host is new once, and what moves shrinks by the damping each round.
    """
    both = links.selectExpr("0 AS kind", "source AS at", "target AS to", "n").union(links.selectExpr("1", "target", "source", "n"))
    out = cut_lineage(both.groupBy("kind", "at").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / LINKS).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("to"), F.col("chunks")).cast("int")
    steps = cut_lineage(both.join(out, ["kind", "at"]).select("kind", "at", own.alias("chunk"), "to", (F.col("n") / F.col("total")).alias("p")))
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    mass = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("allowed") / F.lit(max(1, sums.a or 0))).alias("mass")), F.struct(F.lit(1).alias("kind"), (F.col("blocked") / F.lit(max(1, sums.b or 0))).alias("mass")))).alias("s"))
    start = (F.col("s.mass") * (1 - damping)).alias("value")
    values = cut_lineage(mass.select("s.kind", "host", start).filter("value > 0").withColumn("moved", F.col("value")))
    moving = not steps.isEmpty()
    while moving:
        # A host's value meets its links chunk by chunk.
        ready = values.filter("moved > 0").select("kind", F.col("host").alias("at"), "moved").join(out.select("kind", "at", "chunks"), ["kind", "at"])
        dealt = ready.select("kind", "at", "moved", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        arrived = dealt.join(steps, ["kind", "at", "chunk"]).select("kind", F.col("to").alias("host"), (F.col("moved") * F.col("p") * damping).alias("value"))
        every = values.select("kind", "host", "value", F.lit(0.0).alias("moved")).union(arrived.select("kind", "host", "value", F.col("value").alias("moved")))
        values = cut_lineage(every.groupBy("kind", "host").agg(F.sum("value").alias("value"), F.sum("moved").alias("moved")))
        moving = not values.filter(F.col("moved") > F.col("value") * tolerance).isEmpty()
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0))
    return values.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[Rule] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """key, host, path, rule (null if none fits), trust, distrust (of the host) and verdict for every row.

    A null url, or one without "://", has an empty host and path: no rule fits, and it is allowed. Null html has no
    links. Repeated rows are judged each, and count as often. An empty table gives an empty result.
    """
    named = pages.select(F.col(quoted(key)).alias("key"), host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"))
    ruled = named.withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.count_if(F.coalesce(F.col("found.verdict") == verdict, F.lit(False)))
    seeds = cut_lineage(ruled.filter("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"), F.count("*").alias("n")))
    scores = spread(seeds, host_links(pages, quoted(url), quoted(html)), damping, tolerance).join(seeds.select("host", "n"), "host")
    blocked = F.col("distrust") > F.col("trust") * (1 + CLOSE)
    joined = by_share(ruled, scores, "host", "n")
    verdict = F.coalesce(F.col("found.verdict"), F.when(blocked, "block").otherwise("allow"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return joined.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), zero("trust"), zero("distrust"), verdict.alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in by_length(RULES)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    a_to_z = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE parsed AS (SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), {a_to_z}) AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS found FROM parsed),
seeds AS (SELECT host, count(*) FILTER (found = 'allow') AS allowed, count(*) FILTER (found = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host),
sums AS (SELECT greatest(1, sum(allowed)) AS a, greatest(1, sum(blocked)) AS b FROM seeds),
v0 AS (SELECT kind, host, mass * {1 - DAMPING} AS value FROM (
    SELECT 0 AS kind, host, allowed / a AS mass FROM seeds, sums UNION ALL SELECT 1, host, blocked / b FROM seeds, sums) WHERE mass > 0),
anchors AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM parsed),
links AS (SELECT src, translate(dst, {a_to_z}) AS dst, count(*) AS n FROM anchors WHERE src <> '' AND src <> translate(dst, {a_to_z}) GROUP BY ALL),
moves AS (SELECT 0 AS kind, src, dst, n FROM links UNION ALL SELECT 1, dst, src, n FROM links),
steps AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS p FROM moves),
walk AS (SELECT kind, host, value, 0 AS round FROM v0 UNION ALL
  SELECT s.kind, s.dst, sum(w.value * s.p * {DAMPING}), any_value(w.round) + 1 FROM walk w JOIN steps s ON w.kind = s.kind AND w.host = s.src WHERE w.round < 200 GROUP BY s.kind, s.dst),
scores AS (SELECT host, coalesce(sum(value) FILTER (kind = 0), 0) AS trust, coalesce(sum(value) FILTER (kind = 1), 0) AS distrust FROM walk GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(found, CASE WHEN distrust > trust * (1 + {CLOSE}) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host"""


SQL = _sql()
