"""Helpers that every corpus operator uses: tables, shared checkpoints, Arrow batches of texts and bounded samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.staging import checkpointed as cut_lineage
from ..operators.staging import quoted, shared_folder

__all__ = ["WORD", "Recent", "bounded_share", "by_share", "crc32_of_id", "cut_lineage", "give_back", "map_texts", "quoted", "read", "set_apart", "shared_folder", "slices", "small_batches", "tree_sum", "utf8", "word_count"]

#: A word is a run of characters other than these six; `bytes.split()` splits at exactly the same set.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of an Arrow batch more tightly than Spark's default, unless the session sets a limit of its own.

    A batch lives in the JVM and several times in a Python worker; long texts make the default of 64 MB heavy.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "1m") == "67108864b":
        spark.conf.set(name, size)


def utf8(text: str) -> Column:
    """The bytes of a text column; what isn't UTF-8 in them is replaced by U+FFFD, one for each broken sequence."""
    return F.make_valid_utf8(F.col(quoted(text)).cast("string")).cast("binary")


def map_texts(frame: DataFrame, text: str, keep: Sequence[str], results: T.StructType, start: Callable[[], Callable[[list[bytes | None]], Iterable[Sequence]]], size: int = 4 << 20, raw: bool = False) -> DataFrame:
    """Adds `results` to the columns `keep`, computed from Arrow batches of UTF-8 texts; `raw` leaves broken bytes as they are.

    `start()` runs once in each task and returns a function from a batch's texts (of about `size` bytes together, or a
    single longer one) to one sequence per result column.
    Texts are handed over whole. Kept columns of a result's name give way to the result.
    """
    small_batches(frame.sparkSession)
    keep = [c for c in dict.fromkeys(keep) if c not in results.names]
    names = [f"__kept_{i}" for i in range(len(keep))]  # a map over batches takes no names with dots
    source = frame.select(*(F.col(quoted(c)).alias(n) for c, n in zip(keep, names, strict=True)), (F.col(quoted(text)).cast("binary") if raw else utf8(text)).alias("__text"))
    types = [to_arrow_type(field.dataType) for field in results]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in stream:
            for part in slices(batch, size):  # however many rows Spark put into the batch
                columns = work(part.column(part.num_columns - 1).to_pylist())
                made = [pa.array(values, kind) for values, kind in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*names, *results.names])
        del work
        give_back()

    schema = T.StructType([*(source.schema[n] for n in names), *results])
    made = source.mapInArrow(batches, schema)
    return made.select(*(F.col(n).alias(c, metadata=frame.schema[c].metadata) for n, c in zip(names, keep, strict=True)), *results.names)


def give_back() -> None:
    """Returns what a finished task freed to the system: a Python worker lives on, and its next task may need it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """(docs under names that clash with nothing, these names by the old ones, the columns that bring the old names back)."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items())), names, [F.col(n).alias(c) for c, n in names.items()]


def by_share(rows: DataFrame, facts: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows left join facts (one row a key, with `count`, the key's number of rows), without a task that holds all rows of a hot key.

    Keys with more than a `share`-th of all counted rows are fewer than `share`, so their facts are broadcast, a proven
    bound; all others are joined by a shuffle, in which a key is small. Both read `rows`. The count isn't handed on.
    """
    facts = cut_lineage(facts)
    limit = (facts.agg(F.sum(count)).first()[0] or 0) / share
    hot, cold = facts.filter(F.col(count) > limit).drop(count), facts.filter(F.col(count) <= limit).drop(count)
    warm = rows.join(F.broadcast(hot), key)
    return warm.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def tree_sum(parts: DataFrame, fan: int = 32) -> dict[int, np.ndarray]:
    """at -> the element-wise sum of the arrays `values` over all rows of this `at`. parts: part (of a task), at, values.

    A task adds at most `fan` arrays up at a time, in the order of their parts. The sums reach the driver: the caller
    bounds how many numbers they hold.
    """
    parts = cut_lineage(parts)
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    add = lambda x, y: F.zip_with(x, y["values"], lambda a, b: a + b)
    while True:
        listed = parts.groupBy(F.expr(f"part div {fan}").alias("part"), "at").agg(F.array_sort(F.collect_list(F.struct("part", "values"))).alias("all"))
        parts = listed.select("part", "at", F.aggregate(F.slice("all", 2, fan), F.col("all")[0]["values"], add).alias("values"))
        left = -(-left // fan)
        if left == 1:
            table = parts.select("at", "values").toArrow()
            return {at: v.values.to_numpy() for at, v in zip(table.column("at").to_pylist(), table.column("values"), strict=True)}


def word_count(text: Column) -> Column:
    """Number of words, 0 for null, in JVM code: a word starts where no other character of a word precedes."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Recent(dict):
    """A cache of at most 2 * size entries, filled by `make` (a method): what is in use moves on when a generation is full."""

    size = 200_000

    def __init__(self):
        super().__init__()
        self.last: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.last = dict(self)
            self.clear()
        self[key] = value
        return value


def crc32_of_id(key: str) -> Column:
    return F.crc32(F.col(quoted(key)).cast("string").cast("binary"))


def bounded_share(total: int, bound: int, key: Column, seed: str) -> Column:
    """True for about `bound` of `total` rows, chosen by a hash of the key, so the same rows in every run."""
    if total <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * bound / total)
