"""Health and quality metrics: one grouped query each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate(test: Column) -> Column:
    return F.count_if(test) / F.count("*")


def poll_counts(marked: DataFrame) -> DataFrame:
    """A2: inserted and duplicate rows of each file."""
    return marked.groupBy("source_id", "path").agg(F.count_if("inserted").alias("inserted"), F.count_if(~F.col("inserted")).alias("duplicates"))


def health(attempts: DataFrame) -> DataFrame:
    """A4, R6, W4: of each source the failures since its last success, its state and whether it stays enabled.

    attempts: source_id, attempted_at, attempt_id, outcome (ok, or the failure's state). One pass of grouped maxima: the
    failures after the latest success are those whose (time, id) is larger.
    """
    at = F.struct("attempted_at", "attempt_id")
    good = attempts.filter("outcome = 'ok'").groupBy("source_id").agg(F.max(at).alias("good"))
    marked = attempts.join(good, "source_id", "left")
    after = (F.col("outcome") != "ok") & (F.col("good").isNull() | (at > F.col("good")))
    grouped = marked.groupBy("source_id").agg(F.count_if(after).alias("consecutive_failures"), F.max_by("outcome", at).alias("last"), F.max("good.attempted_at").alias("last_success_at"))
    state = F.when(F.col("last") == "ok", "healthy").when(F.col("last") == "drift", "selector_broken").when(F.col("last").isin("rate_limited", "selector_broken", "stale", "reauth_required"), F.col("last")).when(F.col("last") == "not_found", "disabled").otherwise("stale")
    return grouped.select("source_id", "consecutive_failures", state.alias("state"), (~F.col("last").isin("drift", "not_found")).alias("enabled"), "last_success_at")


def failure_runs(attempts: DataFrame) -> DataFrame:
    """W4: the running count of failures since the latest success, for each attempt."""
    order = Window.partitionBy("source_id").orderBy("attempted_at", "attempt_id")
    island = attempts.withColumn("island", F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(order))
    run = Window.partitionBy("source_id", "island").orderBy("attempted_at", "attempt_id")
    return island.withColumn("consecutive_failures", F.sum(F.when(F.col("outcome") == "ok", 0).otherwise(1)).over(run)).drop("island")


def model_cost(calls: DataFrame, input_rate: float, output_rate: float) -> DataFrame:
    """A5: tokens, cost and latency by provider, model and prompt version; rates are prices a million tokens."""
    cost = F.col("input_tokens") / 1e6 * input_rate + F.col("output_tokens") / 1e6 * output_rate
    return calls.groupBy("provider", "model", "prompt_version").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost"), F.count("*").alias("calls"), F.percentile_approx("latency_ms", 0.95).alias("latency_p95"))


def dispositions(results: DataFrame) -> DataFrame:
    """A6."""
    return results.groupBy("disposition").agg(F.count("*").alias("n"))


def daily_rates(results: DataFrame, at: str = "captured_at", by: tuple[str, ...] = ("source",)) -> DataFrame:
    """A7, A8, R10: rates of dispositions, exact and suspected duplicates by day."""
    day = F.window(at, "1 day")["start"].alias("day")
    is_ = lambda d: F.col("disposition") == d
    return results.groupBy(day, *by).agg(F.count("*").alias("events"), rate(is_("processed")).alias("success_rate"), rate(is_("review")).alias("review_rate"), rate(is_("ignored")).alias("ignored_rate"), rate(F.col("exact_duplicate")).alias("exact_duplicate_rate"), rate(F.col("suspected_duplicate")).alias("suspected_duplicate_rate"))


def latencies(times: DataFrame, start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A9: exact percentiles of the seconds from start to end."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return times.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(seconds, F.lit(0.5)).alias("p50"), F.percentile(seconds, F.lit(0.95)).alias("p95"), F.max(seconds).alias("longest"))


#: Size of a latency sketch. Up to so many values it is exact; beyond, a quantile's rank is off by under 0.2 % of the
#: values (99 % of the time), also after any number of merges.
SKETCH = 2000


def latency_sketches(times: DataFrame, start: str, end: str, by: tuple[str, ...] = (), period: str = "1 day") -> DataFrame:
    """A9, A7: by and period (of the start): n, longest and a sketch of the seconds from start to end, to be stored and merged.

    A task hands on sketches, never values, so a period with many values is many tasks' work. Rows without one of the
    times don't count.
    """
    seconds = (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("__seconds")
    rows = times.select(*by, F.window(start, period)["start"].alias("start"), seconds).filter("__seconds IS NOT NULL")
    return rows.groupBy(*by, "start").agg(F.count("*").alias("n"), F.max("__seconds").alias("longest"), F.kll_sketch_agg_bigint("__seconds", SKETCH).alias("sketch"))


def rolled_up(sketches: DataFrame, by: tuple[str, ...] = (), period: str = "7 days", offset: str = "4 days") -> DataFrame:
    """The sketches of longer periods: from days to weeks, which start on Mondays."""
    longer = F.window("start", period, period, offset)["start"].alias("start")
    return sketches.groupBy(*by, longer).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_latencies(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """p50 and p95 (values that occur) of stored sketches."""
    at = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))
    return sketches.select(*by, "start", "n", at(0.5).alias("p50"), at(0.95).alias("p95"), "longest")


def latency_counts(times: DataFrame, start: str, end: str, by: tuple[str, ...] = (), period: str = "1 day") -> DataFrame:
    """As `latency_sketches`, but exact: by, period (of the start), seconds from start to end and the number of rows that took so long.

    Counts of values can be stored and merged too; a task hands on a row a value, however many rows have it.
    """
    seconds = (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("seconds")
    rows = times.select(*by, F.window(start, period)["start"].alias("start"), seconds).filter("seconds IS NOT NULL")
    return rows.groupBy(*by, "start", "seconds").agg(F.count("*").alias("n"))


def counts_rolled_up(counts: DataFrame, by: tuple[str, ...] = (), period: str = "7 days", offset: str = "4 days") -> DataFrame:
    """The counts of longer periods: from days to weeks, which start on Mondays."""
    longer = F.window("start", period, period, offset)["start"].alias("start")
    return counts.groupBy(*by, longer, "seconds").agg(F.sum("n").alias("n"))


def counted_latencies(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, p50, p95 (the least values that so many rows don't exceed) and longest of stored counts."""
    group = Window.partitionBy(*by, "start")
    upto = counts.withColumns({"__upto": F.sum("n").over(group.orderBy("seconds")), "__all": F.sum("n").over(group)})
    at = lambda percent: F.min(F.when(F.col("__upto") * 100 >= F.col("__all") * percent, F.col("seconds")))
    return upto.groupBy(*by, "start").agg(F.max("__all").alias("n"), at(50).alias("p50"), at(95).alias("p95"), F.max("seconds").alias("longest"))


def delivery_counts(outbox: DataFrame) -> DataFrame:
    """A10."""
    return outbox.groupBy("destination_type", "status").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))).alias("retries"))


def polls(attempts: DataFrame, now: Column) -> DataFrame:
    """A11: polls attempted and succeeded, and seconds since the last success (null if there was none)."""
    ok = F.col("outcome") == "ok"
    return attempts.groupBy("source_id").agg(F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"), (F.unix_timestamp(now) - F.unix_timestamp(F.max(F.when(ok, F.col("attempted_at"))))).alias("seconds_since_success"))


def created_per(records: DataFrame, period: str = "1 day", at: str = "created_at") -> DataFrame:
    """A12."""
    return records.groupBy(F.window(at, period)["start"].alias("start")).agg(F.count("*").alias("created"))


def sources_per_record(links: DataFrame) -> DataFrame:
    """A13."""
    return links.groupBy("opportunity_id").agg(F.countDistinct("raw_event_id").alias("sources"))


def label_counts(records: DataFrame) -> DataFrame:
    """A13: records by season, employment type and sponsorship, with all subtotals."""
    return records.cube("season", "employment_type", "sponsorship_status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def precision_recall(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A14: of `predicted` against `label`, over the labelled keys."""
    both = labels.join(predictions, key, "left")
    hit, said, is_ = F.count_if(F.col("predicted") & F.col("label")), F.count_if(F.col("predicted")), F.count_if(F.col("label"))
    return both.agg(said.alias("predicted"), is_.alias("labelled"), (hit / said).alias("precision"), (hit / is_).alias("recall"))


def alerts(*rules: tuple[str, DataFrame, str, float]) -> DataFrame:
    """A15: alert, subject, value of every metric row over its limit. A rule: name, frame (subject, value), column, limit."""
    rows = [frame.filter(F.col(column) > limit).select(F.lit(name).alias("alert"), F.col("subject").cast("string").alias("subject"), F.col(column).cast("double").alias("value"), F.lit(float(limit)).alias("limit")) for name, frame, column, limit in rules]
    return reduce(DataFrame.union, rows)
