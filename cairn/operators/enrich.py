"""Joining fetched pages and redirects to events; the fetching itself is elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import urls as ul

PAGES, HOPS = 2, 3


def with_pages(events: DataFrame, pages: DataFrame, most: int = PAGES, deep: bool = False) -> DataFrame:
    """Events (event_id, text, attachment_urls) with the snapshots of their first job pages appended, in the order of the addresses.

    pages: url, final_url, html. Pages without company and role add nothing. deep: postings are sought at any depth of a
    page's records, in Arrow batches, and not in the JVM `pages.DEPTH` levels deep.
    """
    wanted = events.select("event_id", F.posexplode(F.slice(F.filter(ul.urls_in("text", "attachment_urls"), lambda u: ul.is_job_url(u, "enrichment")), 1, most)).alias("pos", "url"))
    page = pg.job_page("html", F.try_parse_json("job")) if deep else pg.job_page("html")
    read = (pg.deep_postings(pages) if deep else pages).select("url", F.coalesce("final_url", "url").alias("final_url"), page.alias("page")).filter("page.company IS NOT NULL OR page.role IS NOT NULL")
    shots = wanted.join(read, "url").select("event_id", F.struct("pos", pg.snapshot(F.col("page"), F.col("url"), F.col("final_url")).alias("text")).alias("s"))
    joined = shots.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "\n\n").alias("__more"))  # at most `most` an event
    return events.join(joined, "event_id", "left").withColumn("text", F.concat_ws("\n\n", F.nullif("text", F.lit("")), "__more")).drop("__more")


def resolve_redirects(urls: DataFrame, redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """url with `resolved` (canonical) or `error`: invalid, not_https, credentials, missing_location or too_many_redirects.

    redirects: url (canonical), status, location. Addresses that aren't in the table lead nowhere else.
    """
    steps = redirects.select(F.col("url").alias("__from"), "status", "location")
    now = urls.withColumns({"resolved": ul.canonical("url"), "error": ul.url_error("url"), "__open": F.lit(True)})
    for hop in range(hops + 1):
        met = now.join(steps, (F.col("resolved") == F.col("__from")) & F.col("__open") & F.col("error").isNull(), "left")
        moves = F.coalesce(F.col("status").between(300, 399), F.lit(False))
        target = F.when(F.startswith("location", F.lit("/")), F.concat(F.lit("https://"), ul.host("resolved"), "location")).otherwise(F.col("location"))
        error = F.when(moves & F.col("location").isNull(), "missing_location").when(moves & F.lit(hop == hops), "too_many_redirects").when(moves, ul.url_error(target))
        now = met.select(*urls.columns, F.when(moves & error.isNull(), ul.canonical(target)).otherwise(F.col("resolved")).alias("resolved"), F.coalesce("error", error).alias("error"), (F.col("__open") & moves).alias("__open"))
    return now.withColumn("resolved", F.when(F.col("error").isNull(), F.col("resolved"))).drop("__open")
