"""Reference inputs for the operators, derived from the star schema by expressions, so that they grow with it.

One pipe row per line item (company, role, place, link, date), chat messages from conversations, poll attempts from
events, table snapshots from orders. `ROWS` and `ATTEMPTS` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CITIZENS, LOCKED, NO_SPONSOR

ACCOUNT = "synthetic/Summer2027"
PLACES = ("Remote US", "New York, NY", "Toronto, Canada", "Remote")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's name and nation and their part's name, type and size. Spark broadcasts what is small."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return lines.join(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


def opportunity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ord, captured_at, text and the columns of an event, one row per line item."""
    f = F.col
    company = F.concat("s_name", F.when(f("l_linenumber") % 2 == 0, " Inc").otherwise(""))
    kind = F.when(f("p_size") % 10 == 0, "Co-op").when(f("p_size") % 10 == 1, "New Grad").otherwise("Intern")
    marker = F.when(f("l_returnflag") == "R", f" {NO_SPONSOR}").when(f("l_returnflag") == "A", f" {CITIZENS}").otherwise("")
    role = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), kind, marker, F.when(f("l_linenumber") == 7, f" {LOCKED}").otherwise(""))
    place = F.element_at(F.array(*map(F.lit, PLACES)), (f("s_nationkey") % 4 + 1).cast("int"))
    link = F.concat(F.lit("[Apply](https://jobs.lever.co/s"), "l_suppkey", F.lit("/p"), "l_partkey", F.when(f("l_linenumber") % 3 == 0, "?utm_source=feed&ref=x").otherwise(""), F.lit(")"))
    posted = F.date_format("l_shipdate", "MMM d")
    text = F.concat(F.lit("| "), F.concat_ws(" | ", company, role, place, link, posted), F.lit(" |"))
    captured = f("l_shipdate") + F.expr("INTERVAL 1 DAY")
    event_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    # Distinct before the texts are made, which would make up most of the shuffle.
    made = line_items(spark, sf_dir).distinct().select(event_id.alias("event_id"), captured.alias("captured_at"), text.alias("text"), "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey")
    null = F.lit(None).cast("string")
    return made.select(
        "event_id", F.concat_ws(" ", F.date_format("captured_at", "yyyyMMdd"), "event_id").alias("ord"), F.lit("github").alias("source"), F.lit(ACCOUNT).alias("source_account"), F.col("event_id").alias("source_event_id"), null.alias("source_url"), "captured_at", "text",
        F.array().cast("array<string>").alias("attachment_urls"), F.lit("README.md").alias("metadata_path"), F.lit("{}").alias("metadata_json"), "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey",
    )


ROWS = f"""rows AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS event_id, l_shipdate + INTERVAL 1 DAY AS captured_at,
  l_suppkey, l_partkey, l_linenumber, l_orderkey, s_nationkey, p_size, l_returnflag, l_shipdate, s_name, p_name, p_type,
  s_name || CASE WHEN l_linenumber % 2 = 0 THEN ' Inc' ELSE '' END AS company,
  p_name || ' ' || p_type || ' ' || CASE WHEN p_size % 10 = 0 THEN 'Co-op' WHEN p_size % 10 = 1 THEN 'New Grad' ELSE 'Intern' END AS role,
  CASE l_returnflag WHEN 'R' THEN ' {NO_SPONSOR}' WHEN 'A' THEN ' {CITIZENS}' ELSE '' END || CASE WHEN l_linenumber = 7 THEN ' {LOCKED}' ELSE '' END AS marks,
  CASE s_nationkey % 4 WHEN 0 THEN 'Remote US' WHEN 1 THEN 'New York, NY' WHEN 2 THEN 'Toronto, Canada' ELSE 'Remote' END AS place,
  'https://jobs.lever.co/s' || l_suppkey || '/p' || l_partkey AS url, CASE WHEN l_linenumber % 3 = 0 THEN '?utm_source=feed&ref=x' ELSE '' END AS tracking, strftime(l_shipdate, '%b %-d') AS posted
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
texts AS (SELECT *, '| ' || company || ' | ' || role || marks || ' | ' || place || ' | [Apply](' || url || tracking || ') | ' || posted || ' |' AS text, strftime(captured_at, '%Y%m%d') || ' ' || event_id AS ord FROM rows)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, attempted_at, attempt_id, outcome: a poll log from the events, errors as failures and purchases as header drift."""
    outcome = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_type") == "purchase", "drift").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("attempt_id"), outcome.alias("outcome"), "value")


ATTEMPTS = "attempts AS (SELECT user_id AS source_id, ts AS attempted_at, event_id AS attempt_id, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'purchase' THEN 'drift' ELSE 'ok' END AS outcome, value FROM events)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages from the turns of conversations, some with a prefix, a link or a forwarded snapshot."""
    f = F.col
    content = F.concat(F.element_at(F.array(*map(F.lit, ("", "[slack] ", "[Instagram] ", "see https://www.slack.com/x "))), (f("conv_id") % 4 + 1).cast("int")), F.coalesce("text", F.lit("")))
    files = "array<struct<url:string,content_type:string,name:string>>"
    snapshot = F.array(F.struct(F.concat(F.lit("fwd "), f("text")).alias("content"), F.array().cast(files).alias("attachments")))
    none = F.array().cast(f"array<struct<content:string,attachments:{files}>>")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + f("conv_id") * 60 + f("turn"))
    return table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lpad("turn", 4, "0")).alias("id"), F.lit("77").alias("guild_id"), (f("conv_id") % 9 + 100).cast("string").alias("channel_id"), content.alias("content"), at.alias("created_at"), f("role").alias("author"), F.array().cast(files).alias("attachments"), F.when(f("turn") % 5 == 4, snapshot).otherwise(none).alias("snapshots"))


HEADERS = ("Company", "Role", "Location", "Application/Link", "Date Posted")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table snapshots (source_id, path, captured_at, content, expected_headers), one file an order; a row without a new company has the inherit marker."""
    f = F.col
    rows = opportunity_rows(spark, sf_dir)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "event_id")
    marked = rows.select("l_orderkey", order.alias("o"), F.when(f("l_linenumber") % 4 == 3, F.regexp_replace("text", r"^\| [^|]* \|", "| ↳ |")).otherwise(f("text")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n")  # an order's few lines
    head = F.when(f("l_orderkey") % 5 == 4, "| Firm | Role | Location | Application/Link | Date Posted |").otherwise(f"| {' | '.join(HEADERS)} |")
    body = marked.groupBy("l_orderkey").agg(lines.alias("lines"))
    return body.select((f("l_orderkey") % 16).alias("source_id"), F.concat(F.lit("orders/"), "l_orderkey", F.lit(".md")).alias("path"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("captured_at"), F.concat(F.lit("# Jobs\n\n"), head, F.lit("\n| --- | :---: | --- | --- | ---: |\n"), "lines").alias("content"), F.array(*map(F.lit, HEADERS)).alias("expected_headers"))
