"""Structured Streaming forms: nonce guard, windowed rates, linkage and observation per micro-batch.

State that must outlive a batch is a published version of tables in a shared folder: a batch reads the version before
its own and publishes one that is named after its batch id. A batch that runs again reads what it read before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import intake, linkage, observations, store, upkeep
from ..plans.process import process


class NonceLife(StatefulProcessor):
    """Keeps when a nonce was last accepted, until its lifetime is over in event time."""

    def __init__(self, lifetime: int):
        self.span = lifetime * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        uses = pd.concat(list(rows)).sort_values(["received_at", "request_id"])
        last, codes = self.last.get()[0] if self.last.exists() else None, []
        for at in (uses.received_at.astype("datetime64[us]").astype("int64") // 1000).tolist():
            fresh = last is None or at - last >= self.span
            last = at if fresh else last
            codes.append(None if fresh else "replayed_nonce")
        self.last.update((last,))
        self.handle.registerTimer(last + self.span)
        yield uses.assign(reject_code=codes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and self.last.get()[0] + self.span <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()  # else it was accepted again meanwhile, and a later timer is set
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def nonce_guard(requests: DataFrame, lifetime: int = intake.NONCE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """All requests with `reject_code`, as `intake.judged_nonces`: replayed_nonce within `lifetime` seconds of the last
    accepted use of (caller, nonce), else null. Milliseconds count.

    requests: caller, nonce, received_at, request_id. A nonce's state goes when the watermark, `delay` behind the latest
    request, has passed the end of its lifetime; requests behind the watermark are dropped. The session's state store
    must be RocksDB (`session.build` sets it).
    """
    schema = T.StructType([*requests.schema, T.StructField("reject_code", T.StringType())])
    grouped = requests.withWatermark("received_at", delay).groupBy("caller", "nonce")
    return grouped.transformWithStateInPandas(NonceLife(lifetime), schema, "append", "eventTime")


def windowed_rates(results: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Dispositions by source in tumbling windows of event time; a window is emitted once the watermark has passed it."""
    n = lambda d: F.sum(F.when(F.col("disposition") == d, 1).otherwise(0)).alias(d)
    grouped = results.withWatermark("captured_at", delay).groupBy(F.window("captured_at", length), "source").agg(F.count("*").alias("events"), n("processed"), n("review"), n("ignored"))
    return grouped.select(F.col("window.start").alias("start"), "source", "events", "processed", "review", "ignored")


def latency_stream(captured: DataFrame, canonical: DataFrame, delivered: DataFrame, delay: str = "1 hour", horizon: str = "1 day") -> DataFrame:
    """A9: event_id, opportunity_id, the three times and the seconds to_canonical and to_delivered, once all three have come.

    captured: event_id, captured_at. canonical: event_id, opportunity_id, canonical_at. delivered: opportunity_id,
    delivered_at. A step that takes longer than `horizon` isn't matched: state is kept for that long behind the watermark,
    `delay` behind the latest rows. Rows behind the watermark are dropped, and the query's progress counts them
    (`late_rows`). `metrics.latencies` of the result is that of a batch.
    """
    within = lambda later, earlier: (F.col(later) >= F.col(earlier)) & (F.col(later) <= F.col(earlier) + F.expr(f"INTERVAL {horizon}"))
    first = captured.withWatermark("captured_at", delay).select("event_id", "captured_at")
    second = canonical.withWatermark("canonical_at", delay).select(F.col("event_id").alias("__event"), "opportunity_id", "canonical_at")
    third = delivered.withWatermark("delivered_at", delay).select(F.col("opportunity_id").alias("__record"), "delivered_at")
    # A join takes one column of event time from each side; the computed copy of the other is a plain time.
    both = first.join(second, (F.col("event_id") == F.col("__event")) & within("canonical_at", "captured_at"))
    both = both.select("event_id", "opportunity_id", "canonical_at", F.timestamp_micros(F.unix_micros("captured_at")).alias("captured_at"))
    every = both.join(third, (F.col("opportunity_id") == F.col("__record")) & within("delivered_at", "canonical_at"))
    seconds = lambda at: F.unix_timestamp(at) - F.unix_timestamp("captured_at")
    return every.select("event_id", "opportunity_id", "captured_at", "canonical_at", "delivered_at", seconds("canonical_at").alias("to_canonical"), seconds("delivered_at").alias("to_delivered"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query dropped because they came behind its watermark."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


def version_before(spark: SparkSession, folder: str, number: int) -> str | None:
    """The version that batch `number` starts from: the last one before its own, never one of an earlier try of it.

    A store that lacks the versions that the stream's progress implies, or is ahead of it, isn't this stream's: an error.
    """
    found = upkeep.versions(spark, folder)
    own = named(number)
    if found and found[-1] > own:
        raise RuntimeError(f"{folder} has versions after {own}: it belongs to another checkpoint")
    before = [v for v in found if v < own]
    if number > 0 and not before:
        raise RuntimeError(f"{folder} has no version before {own}: the store was lost")
    return before[-1] if before else None


def named(number: int) -> str:
    return f"batch-{number:09d}"


def records_of(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The linked records of a published version (else the current one), moved on to their latest observation."""
    return linkage.touch(upkeep.published(spark, folder, "opportunities", version), upkeep.published(spark, folder, "touches", version))


#: What linkage needs of a record.
RECORD = "opportunity_id string, created_at timestamp, last_seen_at timestamp, status string, company string, role string, year int, canonical_url_hash string, stable_job_board string, stable_job_id string, fingerprint string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
INDEXED = f"tag string, key string, {RECORD}"


def link_events(stream: DataFrame, folder: str, checkpoint: str, compact: int = 50, **options) -> DataStreamWriter:
    """Processes each micro-batch of events against the records stored so far; `start()` or `trigger()` it as needed.

    A batch adds its own records, links, outbox rows and observations (touches) to the version before; every `compact`
    batches the tables are written anew as one folder each. Read the records by `records_of`. An event that was seen in
    an earlier batch (by event_id) changes nothing, and a batch that runs again starts from the same version as before.

    What a batch reads doesn't grow with the store: of an index (`operators.store`) the files that can hold its keys, and
    a table of the most recent records, which is all that review of similar events looks at.
    """

    return stream.writeStream.foreachBatch(link_step(folder, compact, **options)).option("checkpointLocation", checkpoint)


def link_step(folder: str, compact: int = 50, **options) -> Callable[[DataFrame, int], None]:
    """What `link_events` does with a micro-batch and its number."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = version_before(spark, folder, number)
        once = linkage.first_of(batch, ["event_id"], ["ord"])
        before = spark.createDataFrame([], RECORD)
        files = None if last is None else upkeep.published(spark, folder, "index", last)
        if files is not None:
            known, _ = store.looked_up(files, once.select(F.lit("e").alias("tag"), F.col("event_id").cast("string").alias("key")), INDEXED)
            once = once.join(known.select(F.col("key").alias("event_id")), "event_id", "left_anti")

        def stored(ready: DataFrame) -> DataFrame:
            nonlocal before
            hits, _ = store.looked_up(files, linkage.key_rows(ready.filter("disposition <> 'ignored'")), INDEXED)
            recent = upkeep.published(spark, folder, "recent", last)
            others = hits.filter("tag <> 'e'").select(*COLUMNS).dropDuplicates(["opportunity_id"]).join(recent, "opportunity_id", "left_anti")
            before = linkage.checkpointed(recent.unionByName(others))
            return before

        made = process(linkage.checkpointed(once), None if last is None else stored, **options)
        seen = made["links"].filter("NOT created").join(made["results"].select(F.col("event_id").alias("raw_event_id"), F.col("captured_at").alias("observed_at")), "raw_event_id")
        tables = {n: made[n] for n in ("opportunities", "links", "outbox")} | {"touches": linkage.checkpointed(seen.groupBy("opportunity_id").agg(F.max("observed_at").alias("observed_at")))}
        new = linkage.checkpointed(made["opportunities"].select(*COLUMNS))
        latest = linkage.recent(linkage.touch(before.unionByName(new), tables["touches"])).select(*COLUMNS)
        nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in RECORD.split(", "))]
        keys = linkage.key_rows(new, *COLUMNS).unionByName(made["links"].select(F.lit("e").alias("tag"), F.col("raw_event_id").cast("string").alias("key"), *nothing))
        index = store.added(files, keys.select("tag", "key", *COLUMNS), f"{folder}/_index")
        if last is not None and number % compact == 0:
            tables = {n: upkeep.published(spark, folder, n, last).unionByName(t) for n, t in tables.items()}
            tables["opportunities"] = linkage.touch(tables["opportunities"], tables["touches"])
            tables["touches"] = tables["touches"].limit(0)
            last = None
        upkeep.publish(tables | {"recent": latest, "index": index}, folder, named(number), last, instead=("recent", "index"))

    return step


def forget(spark: SparkSession, folder: str, keep: int = 3) -> None:
    """Removes all versions of a linkage store but the last `keep`, with what none of these names. For a time without a running stream."""
    upkeep.forget(spark, folder, keep)
    store.forget(spark, f"{folder}/_index", *(upkeep.published(spark, folder, "index", v) for v in upkeep.versions(spark, folder)))


def observe_snapshots(stream: DataFrame, folder: str, checkpoint: str, observed_at: Callable[[DataFrame], str]) -> DataStreamWriter:
    """Moves the observation state on by one full snapshot a micro-batch (absence is only known from a whole snapshot)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = version_before(spark, folder, number)
        before = spark.createDataFrame([], "source_id long, observation_key string, last_seen_at timestamp, consecutive_misses int") if last is None else upkeep.published(spark, folder, "observations", last)
        upkeep.publish({"observations": observations.observe(before.drop("event"), batch, observed_at(batch))}, folder, named(number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
