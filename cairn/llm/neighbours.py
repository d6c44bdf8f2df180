"""Approximate nearest neighbours by collision counting over sorted projections.

Unit vectors are projected on a number of random directions. Each block of vectors builds one sorted array for each
direction, once, and the queries travel to the blocks. A query opens a window around its own projection in every array;
the window's width goes with a radius R that grows (virtual rehashing: the arrays stay as they are), and only what
newly enters a window is counted, so that a query touches a vector at most once a direction. A vector that lies in enough
windows has probably a distance under R; it is verified on the original vectors. A query is done when its k-th best
verified distance is under R, so the chance to miss a true neighbour is that of a binomial tail, the same at every size.

Every query meets every block, as a search against all rows has it: vectors are shuffled once (for CHUNK queries),
queries once a block. Equal vectors are searched once: of each distinct vector the few smallest ids are kept, which is
all that an answer can show of it, so a vector that fills a third of the table costs as one.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import by_share, cut_lineage, quoted, read

#: Directions; half a window's width for radius 1 (in it lies the projection of a difference of that length with
#: probability 0.683); collisions needed, one and a half standard deviations below the mean at distance R.
DIRECTIONS, HALF = 96, 1.0
NEEDED = int(0.683 * DIRECTIONS - 1.5 * math.sqrt(DIRECTIONS * 0.683 * 0.317))
GROWTH, SEED, SAMPLE = 1.15, 42, 256
#: Vectors of a block; queries for which a block's vectors are sent once more; queries of one round of windows.
BLOCK, CHUNK, ROUND = 50_000, 1 << 18, 256
#: Cosines so close to the last that counts are settled by the exact score and the id.
CLOSE = 1e-12


def usable(vector: Column) -> Column:
    """Not null, all components finite numbers, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled by powers of two against overflow, their lengths)."""
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


class Block:
    """A block's vectors with their sorted projections. `touched` counts the window entries of all searches."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.lengths = unit(vectors)
        self.units = self.vectors / self.lengths[:, None]
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIRECTIONS))
        at = np.ascontiguousarray((self.units @ self.directions).T)
        self.order = np.argsort(at, axis=1).astype(np.int32)
        self.arrays = np.take_along_axis(at, self.order, axis=1)
        self.touched = 0

    def collide(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, cosines) of verified vectors, among them the k nearest with high probability: all
        that come close to the k-th best or better."""
        q, q_length = unit(queries)
        q_unit = q / q_length[:, None]
        n, k = len(self.units), min(k, len(self.units))
        of = np.ascontiguousarray((q_unit @ self.directions).T)
        # The first radius: a little under the distance to the second nearest of a few vectors (the nearest may be the query).
        few = self.units[:: max(1, n // SAMPLE)]
        near = np.sort(q_unit @ few.T, axis=1)[:, -min(2, len(few))]
        radius = 0.9 * np.sqrt(np.maximum(2 - 2 * near, 1e-6))
        low = np.stack([np.searchsorted(a, p) for a, p in zip(self.arrays, of, strict=True)])
        high = low.copy()
        counts = np.zeros((len(q), n), np.uint8)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
        best = np.full((len(q), k), -np.inf)
        active = np.arange(len(q))
        while active.size:
            wide = HALF * radius[active]
            lower = np.stack([np.searchsorted(a, p[active] - wide, "left") for a, p in zip(self.arrays, of, strict=True)])
            upper = np.stack([np.searchsorted(a, p[active] + wide, "right") for a, p in zip(self.arrays, of, strict=True)])
            for column, i in enumerate(active.tolist()):
                edges = zip(self.order, lower[:, column].tolist(), low[:, i].tolist(), high[:, i].tolist(), upper[:, column].tolist(), strict=True)
                entered = np.concatenate([part for o, a, b, c, d in edges for part in (o[a:b], o[c:d])])
                self.touched += len(entered)
                before = counts[i]
                after = before + np.bincount(entered, minlength=n).astype(np.uint8)
                # At radius 2 every vector is within reach.
                new = np.flatnonzero((before < NEEDED) & ((after >= NEEDED) | (radius[i] >= 2)))
                counts[i], low[:, i], high[:, i] = after, lower[:, column], upper[:, column]
                if new.size:
                    cosine = self.units[new] @ q_unit[i]
                    found[i].append((new, cosine))
                    best[i] = -np.sort(-np.concatenate([best[i], cosine]))[:k]
            farthest = np.sqrt(np.maximum(2 - 2 * np.maximum(best[active, -1], -1), 0))
            more = (farthest > radius[active]) & (radius[active] < 2)
            active, farthest = active[more], farthest[more]
            # No farther than the k-th best so far: at that radius the query is done.
            radius[active] = np.minimum(radius[active] * GROWTH, np.maximum(farthest, radius[active] * 1.01))
        answers = []
        for i, parts in enumerate(found):
            at, cosine = (np.concatenate(c) for c in zip(*parts, strict=True))
            near = at[cosine >= best[i, -1] - CLOSE]
            # The few that count, once more as the plain sum: equal numbers give equal scores wherever they stand.
            answers.append((near, (self.vectors[near] * q[i]).sum(axis=1) / (self.lengths[near] * q_length[i])))
        return answers


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def met(rows: DataFrame, k: int) -> DataFrame:
    """question, score, members: the k nearest classes that each block finds for each question.

    rows: d, block, chunk, side (0 vector, 1 question), v, question, members. A task holds one block and a batch of questions.
    """
    schema = T.StructType([T.StructField("question", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("members", T.ArrayType(T.LongType()))])

    def work(stream):
        now, vectors, members, block, first = None, [], [], None, None
        for batch in stream:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            cuts = [0, *(1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                part, group = batch.slice(a, b - a), tuple(keys[:3, a].tolist())
                if group != now:
                    now, vectors, members, block = group, [], [], None
                if keys[3, a] == 0:
                    vectors.append(matrix(part.column("v")))
                    members += part.column("members").to_pylist()
                    continue
                if not vectors:
                    continue
                if block is None:
                    block, first = Block(np.concatenate(vectors)), np.array([m[0] for m in members])
                for at in range(0, part.num_rows, ROUND):
                    some = part.slice(at, ROUND)
                    out = []
                    for question, (near, cosine) in zip(some.column("question").to_pylist(), block.collide(matrix(some.column("v")), k), strict=True):
                        out += [(question, float(cosine[t]), members[near[t]]) for t in np.lexsort((first[near], -cosine))[:k].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], names=schema.names)

    return rows.repartition("d", "block", "chunk").sortWithinPartitions("d", "block", "chunk", "side").mapInArrow(work, schema)


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: the k nearest found of each row that `is_query` marks, its own row left out.

    score is the cosine in double precision; nearest first, ties to the smaller key; all candidates if fewer than k.
    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without a key.
    Vectors of different lengths aren't compared. Rows of equal key and vector count once. An empty table gives an
    empty result. Other columns are ignored.
    """
    # Components travel in the type they have (float stays half as wide as double) and become doubles where they're used.
    element = vectors.schema[vector].dataType.elementType
    components = F.col(quoted(vector)) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(quoted(vector)).cast("array<double>")
    valid = vectors.select(F.col(quoted(key)).alias("id"), components.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    # Repeated rows are summed up in their tasks, then Spark prunes to k + 1 ids a vector before the shuffle (window group limit).
    smallest = valid.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = cut_lineage(smallest.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("members")))
    asking = cut_lineage(valid.filter("asks").select("id", "v").distinct())
    questions = cut_lineage(asking.groupBy("v").agg(F.min("id").alias("question"), F.count("*").alias("n")))
    blocks, chunks = max(1, -(-classes.count() // BLOCK)), max(1, -(-questions.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    long, ids = T.LongType(), T.ArrayType(T.LongType())
    left = classes.select(F.size("v").alias("d"), F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("side"), "v", F.lit(None).cast(long).alias("question"), "members")
    right = questions.select(F.size("v").alias("d"), every(blocks).alias("block"), F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("side"), "v", "question", F.lit(None).cast(ids).alias("members"))
    # k + 1 distinct vectors a question: one of them may be the query's own and hold no other row.
    found = met(left.union(right), k + 1).withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), F.col("members")[0]))).filter(F.col("n") <= k + 1)
    nearest = found.groupBy("question").agg(F.collect_list(F.struct("score", "members")).alias("nearest"))  # k + 1 at most
    answers = by_share(asking, questions.join(nearest, "question").select("v", "n", "nearest"), "v", "n").select(F.col("id").alias("query_id"), F.explode("nearest").alias("hit"))
    rows = answers.select("query_id", "hit.score", F.explode("hit.members").alias("id")).filter("id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
