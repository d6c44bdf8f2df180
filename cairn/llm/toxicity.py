"""Toxicity by maximum-scoring segments over token log-odds.

A token's log-odds compare labelled toxic with labelled clean texts. Word prefixes of growing length form a chain of
Dirichlet priors: each estimate shrinks toward that of the shorter prefix, the shortest toward no evidence, so a word
that training never saw inherits what its beginning tells. A linear-time scan finds all maximal scoring segments of a
text; those whose normalised score (lambda * S - ln(K * n), the extreme-value law of chance maxima in a text of n
tokens) is positive are the significant passages. A text's statistic is the sum of their normalised scores, and a
logistic curve, fitted on labelled texts that did not take part in the counts, turns it into a probability.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Recent, bounded_share, crc32_of_id, cut_lineage, map_texts, quoted, read, set_apart, utf8

#: The labelled rows that the fit takes, at most about so many; a fifth of them calibrates.
TRAINING_ROWS = 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of a prior, evidence below which a feature isn't kept, and what a token pays for lengthening a passage.
PRIOR, LEAST, TOLL = 20.0, 12, 0.5
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
GRID = np.linspace(0.05, 4.0, 80)
EULER = 0.5772156649015329


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.decode().lower().encode()) if text else []


def chain(token: bytes) -> list[bytes]:
    """The token's prefixes (marked by a star), shortest first, then the token."""
    return [token[:k] + b"*" for k in PREFIXES if len(token) > k] + [token]


class LogOdds(Recent):
    """Token -> log-odds of toxic against clean, less the toll."""

    size = 100_000

    def __init__(self, counts: dict[bytes, tuple[int, int]], share: float):
        super().__init__()
        self.counts, self.share = counts, share

    def make(self, token: bytes) -> float:
        ratio = 1.0
        for feature in chain(token):
            toxic, clean = self.counts.get(feature, (0, 0))
            ratio = (toxic + PRIOR * ratio) / (clean * self.share + PRIOR)
        return math.log(ratio) - TOLL


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal scoring segments in order, in linear time.

    Each positive token opens a candidate. It joins the nearest earlier candidate whose left sum is lower, if the sum
    up to its own end tops that candidate's, and takes the candidates between them along; only positive tokens matter.
    Every candidate knows its own nearest earlier one with a lower left sum, so the search skips what it can't join and
    looks at no candidate twice.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    lefts, rights, starts, ends, lower = [], [], [], [], []  # sum before, sum at the end, start, end, the candidate to go on with
    for i, right, left in zip(at.tolist(), total[at].tolist(), (total[at] - scores[at]).tolist(), strict=True):
        start, j = i, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = lower[j]
            if j < 0 or rights[j] >= right:
                break
            left, start, onward = lefts[j], starts[j], lower[j]
            for held in (lefts, rights, starts, ends, lower):
                del held[j:]
            j = onward
        lefts.append(left)
        rights.append(right)
        starts.append(start)
        ends.append(i + 1)
        lower.append(j)
    return [(r - a, s, e) for a, r, s, e in zip(lefts, rights, starts, ends, strict=True)]


@dataclass
class Model:
    counts: dict[bytes, tuple[int, int]]
    share: float
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 1.0
    bias: float = -3.0

    @functools.cached_property
    def odds(self) -> LogOdds:
        return LogOdds(self.counts, self.share)

    def scores(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.odds.__getitem__, words), np.float64, len(words))

    def statistic(self, scores: np.ndarray) -> float:
        return sum(s for s, _, _ in self.passages(scores))

    def passages(self, scores: np.ndarray) -> list[tuple[float, int, int]]:
        """(normalised score, start, end) of the significant segments."""
        chance = math.log(self.scale * max(1, len(scores)))
        return [(s, a, b) for raw, a, b in segments(scores) if (s := self.decay * raw - chance) > 0]

    def probability(self, statistic: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.bias + self.slope * math.log1p(statistic))))


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, toxic, clean: damped counts, 4 * (1 + ln k) rounded for k occurrences in a text. Summed up in each task first."""

    def work(stream):
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in stream:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen: Counter = Counter()
                for token, k in Counter(tokens(text.as_py())).items():
                    for feature in chain(token):
                        seen[feature] += k
                for feature, k in seen.items():
                    sums[label][feature] += round(4 * (1 + math.log(k)))
        names = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([sums[1][f] for f in part], pa.int64()), pa.array([sums[0][f] for f in part], pa.int64())], names=["feature", "toxic", "clean"])

    counted = sample.select("text", "label").mapInArrow(work, "feature binary, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by damped Newton steps, with a weak pull of the slope toward 1."""
    w = np.array([1.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + np.array([w[0] - 1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1.0, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model from at most about `rows` labelled texts, chosen by a hash of the key. Only the labels that `labels` holds are seen.

    Rows with a null key, label or text teach nothing; of repeated keys the larger label and the smallest text count.
    Without both classes the model knows no toxic token and scores every text alike.
    """
    known = labels.filter(F.col(quoted(key)).isNotNull() & F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(key)).alias("key")).agg(F.max((F.col(quoted(label)) > 0).cast("int")).alias("label"))
    chosen = known.filter(bounded_share(known.count(), rows, F.col("key"), "toxicity")).withColumn("part", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("part")), F.lit(5)))
    source = docs.select(F.col(quoted(key)).alias("key"), utf8(text).alias("text")).filter("text IS NOT NULL")
    joined = source.join(F.broadcast(chosen), "key")  # `chosen` has at most about `rows` rows
    sample = cut_lineage(joined.groupBy("key", "label", "part").agg(F.min("text").alias("text")))
    counted = feature_counts(sample.filter("part > 0"))
    totals = counted.agg(F.sum("toxic"), F.sum("clean")).first()
    if not totals[0] or not totals[1]:
        return Model({}, 1.0, slope=0.0)
    share = totals[0] / totals[1]
    table = counted.filter((F.col("toxic") >= LEAST) | (F.col("clean") * F.lit(share) >= LEAST)).toPandas()
    model = Model({bytes(f): (int(a), int(b)) for f, a, b in zip(table.feature, table.toxic, table.clean, strict=True)}, share)
    held = sample.filter("part = 0").select("text", "label")
    chance_law(model, held.filter("label = 0"))
    found = statistics_of(held, model)  # a fifth of `rows`
    y = np.array([float(label > 0) for label, _ in found])
    if y.any() and not y.all():
        model.slope, model.bias = logistic(np.log1p([s for _, s in found]), y)
    return model


def chance_law(model: Model, clean: DataFrame) -> None:
    """Sets lambda so that the mean of exp(lambda * score) over clean tokens is 1, and K from the mean of the clean texts' maxima.

    A task sums up the moments of all its tokens, a slice of a text at a time; a text hands on its length and maximum.
    """
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def work(stream):
        model, sums, rows = shared.value, np.zeros(len(GRID)), []
        for batch in stream:
            for t in batch.column(0):
                scores = model.scores(tokens(t.as_py()))
                for at in range(0, len(scores), 8192):
                    sums += np.exp(np.outer(GRID, scores[at : at + 8192])).sum(axis=1)
                if len(scores):
                    rows.append((len(scores), max((s for s, _, _ in segments(scores)), default=0.0), None))
        rows.append((0, 0.0, sums.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["n", "best", "moments"])

    found = clean.mapInArrow(work, "n long, best double, moments array<double>").collect()
    shared.destroy()  # workers drop this copy of the model and its cache
    texts = sorted((r.n, r.best) for r in found if r.n)
    if not texts:
        return
    means = np.array([math.fsum(c) for c in zip(*(r.moments for r in found if r.moments), strict=True)]) / sum(n for n, _ in texts)
    model.decay = float(GRID[np.flatnonzero(means <= 1)[-1]]) if (means <= 1).any() else float(GRID[0])
    model.scale = math.exp(float(np.mean([model.decay * best - math.log(n) for n, best in texts])) - EULER)


def statistics_of(held: DataFrame, model: Model) -> list[tuple[int, float]]:
    """(label, statistic) of every text, sorted: the same sum over all its passages as a score is made of."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        return lambda texts: [[model.statistic(model.scores(tokens(t))) for t in texts]]

    found = map_texts(held, "text", ("label",), T.StructType([T.StructField("statistic", T.DoubleType())]), start).collect()
    shared.destroy()
    return sorted((r.label, r.statistic) for r in found)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, toxicity (0 to 1) and passages (array of start token, end token, normalised score) for every row.

    The whole text is scanned. Null and empty texts have no passage and the probability of that; bytes that aren't UTF-8 count as U+FFFD. Repeated rows are
    scored each; an empty table gives an empty result; kept columns of the results' names give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def start():
        model = shared.value  # its cache of log-odds serves the whole worker process

        def work(texts):
            probabilities, passages = [], []
            for t in texts:
                found = model.passages(model.scores(tokens(t)))
                passages.append([{"start": a, "end": b, "score": s} for s, a, b in found])
                probabilities.append(model.probability(sum(s for s, _, _ in found)))
            return probabilities, passages

        return work

    return map_texts(docs, text, keep, T.StructType([T.StructField("toxicity", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))]), start)


def learn_split(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the key as text, modulo 3, is not 1."""
    return labels.filter(F.pmod(crc32_of_id(key), F.lit(3)) != 1)


def op9(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, learn_split(read(spark, sf_dir, "labels")))
    scored = score(docs, model)
    held_out = F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose toxicity is below the threshold. `labels` are the rows to learn from."""
    inner, names, back = set_apart(docs)
    return score(inner, fit(docs, labels, key, text), names[text], tuple(inner.columns)).filter(F.col("toxicity") < threshold).select(*back)
