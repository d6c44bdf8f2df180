"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

The documents of a source queue in a shuffled order that depends on their content alone, once for each of the `repeats`
allowed. A word's virtual finish time is the source's words up to and including it, divided by the source's weight; a
copy's is that of its last word. The queue of copies is range-sorted by finish time over the whole cluster, prefix sums
of the partitions tell in which one the budget is spent, and there it is truncated. A source that has run dry has no
copies left, so its part goes to the others. Whole copies miss the cut by less than one copy a source, so what is being
served around it queues once more in slices of a 64th, these again, and at last word by word: the words taken are those
of a queue that serves single words.

Running totals are distributed: a source is dealt into buckets by the shuffle's hash, each bucket's total is summed up
first, and a window adds up within one bucket only. Equal rows have one hash; where they are more than a SHARE-th of all
rows they are numbered by the tasks that hold them, so that a source or a text that fills most of the rows is many
tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import WORD, cut_lineage, quoted, read, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, REPEATS = 1.5, 2
#: Slices of a copy, or of a slice, that is being served at the cut; rows of one window, and entries of one range
#: partition, on average, as long as these are at most RANGE_PARTS (the 2e10 documents of 1e13 words: 2 million each).
SLICES = 64
BUCKET_ROWS, RANGE_ROWS, RANGE_PARTS = 5_000, 200_000, 20_000
#: Equal rows that are more than a SHARE-th of all are split; of such groups there are fewer than SHARE.
SHARE = 1000


def ranked_sources(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """name, source_size, weight, rank: the weights go round over the sources in code point order, null last.

    Ranks come from the counts of range-sorted partitions, so the sources needn't fit into one task.
    """
    totals = sizes.groupBy("source", "name").agg(F.sum("size").alias("source_size"))
    placed = cut_lineage(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.col("at") - F.col("first") + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return cut_lineage(placed.join(parts, "part").select("name", "source_size", weight.alias("weight"), rank.alias("rank")))


def virtual_now(sources: DataFrame, budget: float, repeats: int) -> float:
    """The virtual time that gives the targets: the sum of least(repeats * size, weight * now) is `budget` of all words.

    Sources that would be served over their limit are set to it and the rest is shared anew, until none is above; the
    driver sees sums only, one job for each round of sources that reach their limit.
    """
    limit = F.col("source_size") * F.lit(repeats)
    now, due = 0.0, budget * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while due > 0:
        dry = (limit <= F.col("weight") * F.lit(now)) | (F.col("source_size") == 0)
        spent, active = sources.agg(F.sum(F.when(dry, limit)), F.sum(F.when(~dry, F.col("weight")))).first()
        if not active or (later := (due - (spent or 0)) / active) <= now:
            break
        now = later
    return now


def named(docs: DataFrame, carry: F.Column, text: str, source: str) -> DataFrame:
    """`carry`, the source, its name without nulls (so that windows and joins share a partitioning), size, and the shuffle's hash of the row."""
    plain = [quoted(c) for c in docs.columns if isinstance(docs.schema[c].dataType, (T.StringType, T.IntegralType))]
    name = F.coalesce(F.concat(F.lit("="), F.col(quoted(source)).cast("string")), F.lit(""))
    return docs.select(carry.alias("row"), F.col(quoted(source)).alias("source"), name.alias("name"), word_count(F.col(quoted(text))).alias("size"), F.xxhash64(*plain).alias("shuffle"))


def ranged(entries: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(entries range-sorted into partitions by finish and rank, with part; words, and words before, of each partition)."""
    ordered = cut_lineage(entries.repartitionByRange(parts, "finish", "rank").withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    return ordered, cut_lineage(ordered.groupBy("part").agg(F.sum("words").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))))


def within(ordered: DataFrame, sums: DataFrame, due: int) -> tuple[DataFrame, int] | None:
    """(the entries of the partition in which the first `due` words of the queue end, with the words before each; its number)."""
    crossing = sums.filter((F.col("before") < due) & (F.col("before") + F.col("words") >= due)).first()
    if crossing is None:
        return None
    queue = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.filter(F.col("part") == crossing.part).withColumn("before", F.coalesce(F.sum("words").over(queue), F.lit(0)) + crossing.before), crossing.part


def time_of(ordered: DataFrame, sums: DataFrame, due: int) -> float | None:
    """The finish time at which the queue has served `due` words."""
    found = within(ordered, sums, due)
    return None if found is None else found[0].filter(F.col("before") + F.col("words") >= due).agg(F.min("finish")).first()[0]


def served_words(entries: DataFrame, due: int, sources: int) -> DataFrame:
    """name, served: the words of each source among the first `due` words of the queue.

    entries: name, rank, weight, start (the source's words before) and words. Words of equal finish times are served in
    the order of the sources' ranks.
    """
    finish = lambda at: (F.col("start") + at) / F.col("weight")
    total = lambda frame: frame.groupBy("name").agg(F.sum("words").alias("served"))
    served = []
    while True:
        entries = cut_lineage(entries)
        rows, longest = entries.agg(F.count("*"), F.max("words")).first()
        ordered, sums = ranged(entries.withColumn("finish", finish(F.col("words"))), max(1, min(RANGE_PARTS, -(-rows // RANGE_ROWS))))
        if not rows or due <= 0:
            break
        high = time_of(ordered, sums, due)
        if high is None:  # all words are due
            served.append(total(ordered))
            break
        if longest == 1:
            last, part = within(ordered, sums, due)
            served.append(total(ordered.filter(F.col("part") < part).select("name", "words").union(last.filter(F.col("before") < due).select("name", "words"))))
            break
        # Whole entries fall short of the words by less than one a source, so the cut lies between these times.
        low = time_of(ordered, sums, due - longest * sources)
        early = F.col("finish") < F.lit(-1.0 if low is None else low)
        whole = cut_lineage(total(ordered.filter(early)))
        served.append(whole)
        due -= whole.agg(F.sum("served")).first()[0] or 0
        step = max(1, longest // SLICES)
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(step).cast("long")))
        cut = ordered.filter(~early & (finish(1) <= high)).select("name", "rank", "weight", "start", "words", starts.alias("at"))
        entries = cut.select("name", "rank", "weight", (F.col("start") + F.col("at")).alias("start"), F.least(F.lit(step), F.col("words") - F.col("at")).alias("words"))
    if not served:
        return total(entries.limit(0))
    every = served[0]
    for more in served[1:]:
        every = every.union(more)
    return every.groupBy("name").agg(F.sum("served").alias("served"))


GROUP = ["name", "shuffle", "size"]


def numbered(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of the hot groups with `number`, which counts the equal rows of each from 0.

    A task numbers its own rows, from where the tasks before it end: no window holds a group.
    """
    held = cut_lineage(rows.join(F.broadcast(hot), GROUP).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
    parts = held.groupBy(*GROUP, "part").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(*GROUP, "part").orderBy(F.lit(1))
    return held.join(parts, [*GROUP, "part"]).withColumn("number", F.row_number().over(own) - 1 + F.col("ahead")).drop("part", "ahead")


def queue(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """rows (as `named` gives them) with source_size, weight, target, served (words that the mix takes of the source) and
    before: the source's words ahead of the row's first copy."""
    sizes = cut_lineage(rows.select("source", "name", "size", "shuffle"))
    sources = ranked_sources(sizes, weights)
    now = virtual_now(sources, budget, repeats)
    total = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    hot = cut_lineage(sizes.groupBy(*GROUP).count().filter(F.col("count") > max(BUCKET_ROWS // 10, total.rows // SHARE)).select(*GROUP))
    crowded = not hot.isEmpty()
    place = {"bucket": F.pmod(F.col("shuffle"), F.lit(max(1, -(-total.rows // BUCKET_ROWS)))), "own": F.lit(None).cast("struct<shuffle:long,size:long>")}
    alone = place | {"own": F.struct("shuffle", "size")}  # a hot group stands by itself, after its bucket's other rows
    # One row for each source and bucket: a window over a source sees as many rows as it has buckets.
    ahead = Window.partitionBy("name").orderBy("bucket", "own").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("name", "bucket").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, -1)

    def dealt(some: DataFrame) -> DataFrame:
        if not crowded:
            return some.withColumns(place)
        return some.join(F.broadcast(hot), GROUP, "left_anti").withColumns(place).unionByName(some.join(F.broadcast(hot), GROUP).withColumns(alone))

    buckets = dealt(sizes.drop("source")).groupBy("name", "bucket", "own").agg(F.sum("size").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    offsets = cut_lineage(buckets.join(sources, "name").select("name", "bucket", "own", "offset", "source_size", "weight", "rank"))

    def placed(some: DataFrame) -> DataFrame:
        cold = some.join(F.broadcast(hot), GROUP, "left_anti") if crowded else some
        own = cold.withColumns(place).drop("own").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        found = own.join(offsets.filter("own IS NULL").drop("own"), ["name", "bucket"])
        if crowded:
            facts = F.broadcast(offsets.filter("own IS NOT NULL").select("name", "bucket", "own.*", "offset", "source_size", "weight", "rank"))
            found = found.unionByName(numbered(some, hot).withColumn("before", F.col("number") * F.col("size")).drop("number").join(facts, GROUP))
        return found.withColumn("before", F.col("before") + F.col("offset"))

    copies = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    own = placed(sizes.select("name", "size", "shuffle")).filter("size > 0").withColumn("copy", copies)
    entries = own.select("name", "rank", "weight", (F.col("before") + F.col("source_size") * F.col("copy")).alias("start"), F.col("size").alias("words"))
    served = served_words(entries, round(budget * total.words), sources.count())
    target = F.least(F.col("source_size").cast("double") * repeats, F.col("weight") * F.lit(now))
    facts = sources.select("name").join(served, "name", "left").select("name", F.coalesce("served", F.lit(0)).alias("served"))
    return placed(rows).join(cut_lineage(facts), "name").withColumn("target", target)


def taken(copy: int) -> F.Column:
    """Words of the row's copy (0 is the first) that lie before the cut."""
    start = F.col("before") + F.col("source_size") * copy
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - start))


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """key, size, source_size, target (of the row's source) and taken: the words that the mix takes of the row, all copies together.

    size counts words; a null text has none and is never taken. Null sources are one source, the last. Equal rows are
    interchangeable. An empty table gives an empty result. Other columns only take part in the shuffle.
    """
    placed = queue(cut_lineage(named(docs, F.col(quoted(key)), text, source)), weights, budget, repeats)
    words = sum((taken(c) for c in range(1, repeats)), taken(0))
    return placed.select(F.col("row").alias(key), "size", "source_size", "target", words.alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus: the columns of `docs`, a row for each copy served, range-sorted by virtual finish time.

    A copy that the budget cuts keeps its first words. A text without words is never served. Nulls, ties and empty
    tables as in `shares`.
    """
    placed = queue(named(docs, F.struct(*map(quoted, docs.columns)), text, source), weights, budget, repeats)
    copies = F.array(*(F.struct(((F.col("before") + F.col("source_size") * c + F.col("size")) / F.col("weight")).alias("finish"), taken(c).alias("words")) for c in range(repeats)))
    entries = placed.select("row", "size", "shuffle", F.explode(copies).alias("copy")).filter("copy.words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("copy.words").cast("int")), "")
    whole = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("row")[text])
    ordered = entries.orderBy("copy.finish", "shuffle")
    return ordered.select(*(whole.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(read(spark, sf_dir, "documents"))
