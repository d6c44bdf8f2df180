"""Signed intake: header checks, HMAC in built-in functions, permissions and the nonce guard."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import checkpointed

TOLERANCE, NONCE_SECONDS, SECRET_BYTES = 300, 600, 32


def pads(secret: bytes) -> tuple[bytes, bytes]:
    """(inner, outer) key blocks of HMAC-SHA256, made once for each caller on the driver; the secret itself isn't shipped."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac(inner: Column, outer: Column, message: Column) -> Column:
    """Hex HMAC-SHA256 from the key blocks."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def signed_message(caller: Column, at: Column, nonce: Column, body: Column) -> Column:
    return F.concat(F.concat_ws(".", F.lit("v1"), caller, at, nonce, F.lit("")).cast("binary"), body)


def verify(requests: DataFrame, callers: DataFrame, now: Column | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """requests (caller, ts, nonce, signature, body, received_at) with `auth_error`: null, unauthorized or stale_timestamp.

    callers: caller, inner_pad, outer_pad, secret_bytes.
    """
    joined = requests.join(callers, "caller", "left")
    now = F.unix_timestamp("received_at") if now is None else now
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    shaped = like("caller", "^[A-Za-z0-9][A-Za-z0-9_-]{1,63}$") & like("nonce", "^[A-Za-z0-9_-]{16,128}$") & like("ts", r"^\d{10}$") & F.col("signature").isNotNull() & F.coalesce(F.col("secret_bytes") >= SECRET_BYTES, F.lit(False))
    expected = F.concat(F.lit("v1="), hmac(F.col("inner_pad"), F.col("outer_pad"), signed_message(F.col("caller"), F.col("ts"), F.col("nonce"), F.col("body"))))
    stale = F.abs(now - F.col("ts").try_cast("long")) > tolerance
    error = F.when(~shaped, "unauthorized").when(stale, "stale_timestamp").when(F.coalesce(F.col("signature") != expected, F.lit(True)), "unauthorized")
    return joined.withColumn("auth_error", error).drop("inner_pad", "outer_pad", "secret_bytes")


def permitted(events: DataFrame, permissions: DataFrame) -> DataFrame:
    """Events whose (caller, source, source_account) is on the list."""
    return events.join(permissions.select("caller", "source", "source_account").distinct(), ["caller", "source", "source_account"], "left_semi")


def judged_nonces(requests: DataFrame, used: DataFrame | None = None, lifetime: int = NONCE_SECONDS, parts: int | None = None) -> DataFrame:
    """All requests with `reject_code`: replayed_nonce where the (caller, nonce) was accepted less than `lifetime` seconds ago, else null.

    requests: caller, nonce, received_at, request_id. used: caller, nonce, received_at of uses that were accepted before;
    such a use counts from its time on. A use that is rejected doesn't lengthen the lifetime of the one before it. Uses of
    one time are judged by request_id. Rows without caller, nonce or time are rejected as `unauthorized`.

    Uses are range-sorted by key and time, so a key that fills most of the rows is many tasks' work. A task starts from
    the last use that the tasks before it accepted of its first key; the driver hands these on, one of each task, until
    no task ends otherwise than before: a change travels only as far as accepted uses follow each other without a pause.
    """
    spark, columns = requests.sparkSession, requests.columns
    able = F.col("caller").isNotNull() & F.col("nonce").isNotNull() & F.col("received_at").isNotNull()
    time = F.unix_micros(F.col("received_at").cast("timestamp")).alias("__at")
    uses = requests.filter(able).select(F.col("caller").cast("string").alias("__caller"), F.col("nonce").cast("string").alias("__nonce"), time, F.lit(1).alias("__new"), F.struct(*columns).alias("__row"))
    if used is not None:
        old = used.filter(able).select(F.col("caller").cast("string").alias("__caller"), F.col("nonce").cast("string").alias("__nonce"), time, F.lit(0).alias("__new"), F.lit(None).cast(uses.schema["__row"].dataType).alias("__row"))
        first = requests.agg(F.min(F.unix_micros(F.col("received_at").cast("timestamp")))).first()[0]
        uses = uses.unionByName(old.filter(F.col("__at") > F.lit(first) - lifetime * 1_000_000)) if first is not None else uses
    keys = ["__caller", "__nonce", "__at", "__new", F.col("__row.request_id")]
    ranged = uses.repartitionByRange(parts, *keys) if parts else uses.repartitionByRange(*keys)
    held = checkpointed(ranged.sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    span = lifetime * 1_000_000
    line = ["__part", "__caller", "__nonce", "__at", "__new"]

    def judged(stream: Iterator[pa.RecordBatch], starts: dict[int, tuple]) -> Iterator[tuple[pa.RecordBatch, list[bool], tuple]]:
        now, last = None, 0
        for batch in stream:
            accepted = []
            for part, caller, nonce, at, new in zip(*(batch.column(c).to_pylist() for c in line), strict=True):
                if (caller, nonce) != now:
                    start = starts.get(part) if now is None else None
                    now, last = (caller, nonce), start[1] if start and start[0] == (caller, nonce) else None
                fresh = not new or last is None or at - last >= span
                accepted.append(fresh)
                if fresh:
                    last = at if last is None else max(last, at)
            yield batch, accepted, (now, last)

    ends: dict[int, tuple] = {}
    starts: dict[int, tuple] = {}
    while True:
        shared = spark.sparkContext.broadcast(starts)

        def last_of(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            end, part = None, None
            for batch, _, end in judged(stream, shared.value):
                part = batch.column("__part")[0].as_py() if batch.num_rows else part
            if part is not None:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "caller": pa.array([end[0][0]]), "nonce": pa.array([end[0][1]]), "at": pa.array([end[1]], pa.int64())})

        found = {r.part: ((r.caller, r.nonce), r["at"]) for r in held.select(*line).mapInArrow(last_of, "part int, caller string, nonce string, at long").collect()}  # a row a task
        changed, ends = found != ends, found
        order = sorted(ends)
        starts = {after: ends[part] for part, after in itertools.pairwise(order)}
        if not changed:
            break
    shared = spark.sparkContext.broadcast(starts)

    def verdicts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, accepted, _ in judged(stream, shared.value):
            yield batch.append_column("__accepted", pa.array(accepted, pa.bool_()))

    made = held.mapInArrow(verdicts, T.StructType([*held.schema, T.StructField("__accepted", T.BooleanType())])).filter("__new = 1")
    code = F.when(~F.col("__accepted"), "replayed_nonce").alias("reject_code")
    others = requests.filter(~able).withColumn("reject_code", F.lit("unauthorized"))
    return made.select(*(F.col("__row").getField(c).alias(c) for c in columns), code).unionByName(others)


def fresh_nonces(requests: DataFrame, used: DataFrame | None = None, lifetime: int = NONCE_SECONDS) -> DataFrame:
    """The requests whose (caller, nonce) wasn't accepted in the `lifetime` before; see `judged_nonces`."""
    return judged_nonces(requests, used, lifetime).filter("reject_code IS NULL").drop("reject_code")
