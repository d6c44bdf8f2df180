"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets, the same number for every corpus. One multinomial describes the raw corpus
(all documents), one the trusted target (all documents with a trusted label, but for the fold that sets the threshold).
A text's score is the mean log-ratio of target to raw over its n-grams, so length plays no part. Every document whose
score is below a fixed threshold is rejected; nothing is drawn at random. The threshold is the score that splits all
labelled texts of the fold best, where rejecting a trusted text costs TRUSTED_COST times as much as keeping another: the
fold grows with the labels, so its scores are range-sorted and the costs of all cuts come from prefix sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut_lineage, give_back, map_texts, quoted, read, set_apart, utf8

#: Bits of a bucket's number (a model of 4 MB); the weight of the raw corpus as the target's prior, in n-grams.
BITS, PRIOR = 20, 16_384
#: Labelled keys that are broadcast, at most, if they are numbers; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 21
#: Distinct scores of a range partition, of which a task sums up one.
SCORES = 200_000
TRUSTED_COST = 4.0
WINDOW = 5
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
PIECE = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


def buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """The buckets of a text's pieces (runs of letters and digits, runs of punctuation) and of their pairs."""
    pieces = PIECE.findall(text)
    hashes = np.fromiter(map(crc32, pieces), np.uint64, len(pieces))
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([hashes * np.uint64(0x9E3779B97F4A7C15), pairs ^ (pairs >> np.uint64(29))]) >> np.uint64(64 - bits)).astype(np.int64)


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text (null: as empty)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    characters = len(text.decode()) - sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated, n = 0, len(words)
    if n > WINDOW:
        # Words by number, windows as tuples of numbers folded into one: exact, for equal windows alone are equal.
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        windows = ids[: n - WINDOW + 1]
        for k in range(1, WINDOW):
            windows = np.unique(windows * len(number) + ids[k : n - WINDOW + 1 + k], return_inverse=True)[1]
        again = np.bincount(windows)[windows] > 1
        if again.any():
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, np.flatnonzero(again), 1)
            np.add.at(depth, np.flatnonzero(again) + WINDOW, -1)
            repeated = int((np.cumsum(depth[:n]) > 0).sum())
    return n, characters, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


@dataclass
class Model:
    ratio: np.ndarray  # log target / raw of each bucket
    threshold: float
    bits: int = BITS

    def score(self, text: bytes | None) -> float:
        """Mean log-ratio of the text's n-grams; without any, 0."""
        found = buckets(text, self.bits) if text else ()
        return float(self.ratio[found].sum()) / len(found) if len(found) else 0.0


def gram_counts(texts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of all texts, of the trusted ones) by bucket. texts: text (binary) and trusted; a task sums up its texts."""

    def work(stream):
        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in stream:
            for text, trusted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, n = np.unique(buckets(text.as_py() or b"", bits), return_counts=True)
                sums[0, found] += n
                if trusted:
                    sums[1, found] += n
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(x[seen]) for x in sums)], names=["bucket", "raw", "target"])
        give_back()

    counted = texts.select("text", "trusted").mapInArrow(work, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table, sums = counted.toArrow(), np.zeros((2, 1 << bits))  # a row a bucket, as columns: 24 bytes each
    bucket, raw, target = (table.column(c).to_numpy() for c in ("bucket", "raw", "target"))
    sums[0, bucket], sums[1, bucket] = raw, target
    return sums[0], sums[1]


def marked(source: DataFrame, trusted: DataFrame) -> DataFrame:
    """source (key, text) with `trusted`, which is null for keys that aren't.

    Labels may grow with the corpus. Up to BROADCAST_KEYS numbers are broadcast, so that no text is shuffled; other keys
    are joined by a shuffle, from which rows without a key stay away.
    """
    known = trusted.select("key").withColumn("trusted", F.lit(True))
    if few_numbers(source, trusted):
        return source.join(F.broadcast(known), "key", "left")
    joined = source.filter("key IS NOT NULL").join(known.hint("shuffle_hash"), "key", "left")
    return joined.unionByName(source.filter("key IS NULL").withColumn("trusted", F.lit(None).cast("boolean")))


def few_numbers(source: DataFrame, known: DataFrame) -> bool:
    return isinstance(source.schema["key"].dataType, T.NumericType) and known.count() <= BROADCAST_KEYS


def cheapest_cut(scored: DataFrame) -> float:
    """`best_threshold` of any number of rows (score, trusted). The driver sees three numbers a range of SCORES distinct scores."""
    sums = cut_lineage(scored.groupBy("score").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("other")))
    ranges = cut_lineage(sums.repartitionByRange(-(-max(1, sums.count()) // SCORES), "score").withColumn("part", F.spark_partition_id()))
    parts = ranges.groupBy("part").agg(F.sum("good").alias("good"), F.sum("other").alias("other"), F.max("score").alias("last")).orderBy("part").toPandas()
    good, other = int(parts.good.sum()), int(parts.other.sum())
    if not good or not other:
        return -np.inf
    before = parts.assign(good=parts.good.cumsum() - parts.good, other=parts.other.cumsum() - parts.other, last=parts["last"].shift())
    facts = scored.sparkSession.createDataFrame([(int(r.part), int(r.good), int(r.other), None if np.isnan(r.last) else float(r.last)) for r in before.itertuples()], "part int, good0 long, other0 long, last double")
    lower = Window.partitionBy("part").orderBy("score")
    upto = lambda c: F.coalesce(F.sum(c).over(lower.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(c + "0")
    # The cut below each score but the lowest: what lies below is rejected.
    cuts = ranges.join(F.broadcast(facts), "part").select("score", F.coalesce(F.lag("score").over(lower), "last").alias("below"), (upto("good") * TRUSTED_COST + other - upto("other")).alias("cost"))
    best = cuts.filter("below IS NOT NULL").agg(F.min(F.struct("cost", "score", "below")).alias("one")).select("one.*").first()
    costs = [float(other), np.inf if best.cost is None else best.cost, good * TRUSTED_COST]
    at = int(np.argmin(costs))
    if at == 0:
        return -np.inf
    # Nearer to what is rejected: keeping is the default.
    return float(best.below + (best.score - best.below) / 4) if at == 1 else float(np.nextafter(parts["last"].iloc[-1], np.inf))


def best_threshold(scores: np.ndarray, trusted: np.ndarray) -> float:
    """The score from which on keeping costs least (in the lowest such gap). Without both classes, minus infinity."""
    if not trusted.any() or trusted.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, trusted = scores[order], trusted[order]
    lost = np.concatenate([[0.0], np.cumsum(trusted) * TRUSTED_COST])
    let_in = np.concatenate([[0], np.cumsum(~trusted)])
    cost = lost + let_in[-1] - let_in
    cost[1:-1][scores[1:] == scores[:-1]] = np.inf  # equal scores stay together
    at = int(cost.argmin())
    if at in (0, len(scores)):
        return -np.inf if at == 0 else float(np.nextafter(scores[-1], np.inf))
    return float(scores[at - 1] + (scores[at] - scores[at - 1]) / 4)  # nearer to what is rejected: keeping is the default


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS) -> Model:
    """Counts all of `docs`, and all of its trusted texts outside a fifth of the labels; all labelled texts of that fifth set
    the threshold.

    Of repeated keys in `labels` the smaller label counts; rows with a null key or label don't. Of repeated keys in
    `docs` the smallest text helps to set the threshold. Without trusted texts, or without others, every document that
    passes the base rules is kept.
    """
    known = labels.filter(F.col(quoted(key)).isNotNull() & F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(key)).alias("key")).agg((F.min(quoted(label)) > 0).alias("trusted"))
    # A fifth of the labelled texts sets the threshold; the target is made of the others, or its own texts would score too well.
    fold = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("fold")), F.lit(5)) == 0
    known = cut_lineage(known.withColumn("held", fold))
    source = docs.select(F.col(quoted(key)).alias("key"), utf8(text).alias("text"))
    raw, target = gram_counts(marked(source, known.filter("trusted AND NOT held")), bits)
    # A Dirichlet prior around the raw corpus: a bucket that the target lacks says little until the target is large.
    prior = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    ratio = np.log((target + PRIOR * prior) / (target.sum() + PRIOR) / prior)
    model = Model(ratio.astype(np.float32), -np.inf, bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        return lambda texts: [[model.score(t) for t in texts]]

    held = known.filter("held").select("key", "trusted")
    judged = source.filter("text IS NOT NULL").join(F.broadcast(held) if few_numbers(source, held) else held.hint("shuffle_hash"), "key").groupBy("key", "trusted").agg(F.min("text").alias("text"))
    scored = cut_lineage(map_texts(judged, "text", ("trusted",), T.StructType([T.StructField("score", T.DoubleType())]), start))
    shared.destroy()
    model.threshold = cheapest_cut(scored)
    return model


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the five base counts, base_failed, quality (the score) and kept for every row.

    base_failed: under 10 words, or over a fifth of them in repeated windows. kept: not base_failed and a score not
    below the threshold. A null text has no word and fails; bytes that aren't UTF-8 count as U+FFFD. Repeated rows are judged each, an empty table gives an
    empty result, and kept columns of the results' names give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def start():
        model = shared.value

        def work(texts):
            counts = [base_counts(t) for t in texts]
            failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
            scores = [model.score(t) for t in texts]
            columns = list(zip(*counts, strict=True)) if counts else [[]] * 5
            return [*columns, failed, scores, [not f and s >= model.threshold for f, s in zip(failed, scores, strict=True)]]

        return work

    return map_texts(docs, text, keep, results, start)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("quality")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    inner, names, back = set_apart(docs)
    return judge(inner, fit(docs, labels, key, text), names[text], tuple(inner.columns)).filter("kept").select(*back)
