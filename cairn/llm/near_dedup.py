"""SimHash near-duplicates with BK-trees.

Every text gets a 64-bit SimHash. Two fingerprints that differ in at most `radius` of 64 bits agree on at least one
of `radius + 1` disjoint blocks of bits (or on some pair of `radius + 2` blocks, and so on). The agreeing bits name a
shard, so each link lies within a shard and none is lost. A shard's BK-tree has its children keyed by their integer
Hamming distance to the parent; a probe at distance d follows only the edges d - radius .. d + radius. The shards'
trees travel by a shuffle and not through the driver, for they hold the fingerprints of the whole corpus, which has no
bound. A shard beyond `shard_rows` is cut into chunks, and each pair of chunks (tree, probes) is a task's work of
bounded size. Within a task links are merged at once, so a group of n copies leaves n - 1 edges and not n * n.

The corpus pipeline's stage (`similar_texts`, `keep_one`) links texts whose sets of five-word shingles have a Jaccard
similarity of LIKE or more. Its SimHash has 512 bits, of which such pairs differ in some 80 and strangers in half; a
shard's BK-tree finds what lies within STAGE_RADIUS, and the exact sets confirm it. Shards can't be named by agreeing
bits here (of 16 bits all agree in 7 % of the pairs at 0.8, which takes 170 tables), so banded minima name them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import by_share, cut_lineage, map_texts, quoted, read, set_apart

SHINGLE, RADIUS = 3, 3
#: The pipeline's stage: words of a shingle; least Jaccard similarity as a fraction of whole numbers; bands of so many minima.
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 24 = 3e-6.
STAGE_SHINGLE, LIKE, BANDS, MINIMA = 5, (4, 5), 24, 4
#: 64-bit words of the stage's fingerprint, and the bits in which a linked pair differs at most. A bit differs with a chance of
#: 0.15 at 0.8, at most 0.19 (four shingles of five): 160 of 512 is 7 deviations beyond 96; strangers are 8 away from it.
PRINT, STAGE_RADIUS = 8, 160
SPREAD = np.random.default_rng(6).integers(0, 2**63, PRINT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.random.default_rng(5).integers(0, 2**63, (3, BANDS * MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the lower-cased shingles, repeats included; no word: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """`keep` and `fp` (the fingerprint as a signed long) for every row, null and empty texts (fingerprint zero) included."""

    def start():
        return lambda texts: [[simhash(t, shingle) for t in texts]]

    return map_texts(docs, text, keep, T.StructType([T.StructField("fp", T.LongType())]), start, raw=True)


def hex_digits(fp: str):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


class Forest:
    """Union by smallest position over the rows of one shard."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bk_links(fps: np.ndarray, tree: np.ndarray, probes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position of a node, positions of the probes within the radius), for the BK-tree over the rows `tree` of `fps`.

    A subtree is unfolded when a probe reaches it: its first row is the root, the others hang under the edge that
    equals their distance to the root, and a probe goes on along the edges that differ from its own distance by no
    more than the radius (the triangle inequality rules out the others).
    """
    open_subtrees = [(tree, probes)]
    while open_subtrees:
        members, probes = open_subtrees.pop()
        root, rest = members[0], members[1:]
        far = np.bitwise_count(fps[probes] ^ fps[root]).astype(np.int16)
        near = probes[far <= radius]
        if near.size:
            yield int(root), near
        if rest.size:
            edges = np.bitwise_count(fps[rest] ^ fps[root]).astype(np.int16)
            for edge in np.unique(edges):
                follow = probes[np.abs(far - edge) <= radius]
                if follow.size:
                    open_subtrees.append((rest[edges == edge], follow))


def shard_edges(fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, smaller fingerprint) that span the linked groups of one shard. side: 0 tree, 1 probe, 2 both."""
    bits = fps.view(np.uint64)
    forest = Forest(len(fps))
    tree, probes = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if tree.size and probes.size:
        for node, near in bk_links(bits, tree, probes, radius):
            for other in near.tolist():
                forest.join(node, other)
    roots = [forest.root(i) for i in range(len(fps))]
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(roots) if i != r]


def links_in_shards(rows: DataFrame, radius: int) -> DataFrame:
    """rows: shard (long pair t, v), chunk pair c, side, fp. One pass over sorted rows; holds one group at a time."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            edges = []
            for a, b in itertools.pairwise(cuts.tolist()):
                if b - a > 1:
                    edges += shard_edges(part[4, a:b], part[3, a:b], radius)
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"])

        held = np.empty((5, 0), np.int64)
        for batch in stream:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])], axis=1)
            if held.shape[1]:
                starts = 1 + np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0))
                if starts.size:
                    yield flush(held, np.concatenate([[0], starts]))
                    held = held[:, starts[-1] :].copy()
        if held.shape[1]:
            yield flush(held, np.array([0, held.shape[1]]))

    return rows.select("t", "v", "c", "side", "fp").repartition("t", "v", "c").sortWithinPartitions("t", "v", "c").mapInArrow(work, schema)


def block_masks(radius: int, agreeing: int) -> list[int]:
    """One mask for each choice of `agreeing` blocks out of `radius + agreeing` blocks of 64 bits, as signed longs."""
    n = radius + agreeing
    at = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(at)]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = 8192, agreeing: int | None = None) -> DataFrame:
    """Edges u, v that connect all distinct fingerprints (column fp) within the radius; exact for every input.

    agreeing: how many of the blocks of bits name a shard. More fingerprints are better off with more of them, so that
    a shard stays small: 4 tables of 16 bits, then 10 of 25, then 20 of 32. The links are the same for each choice.
    """
    if agreeing is None:
        n = distinct.count()
        agreeing = 1 if n <= 4_000_000 else 2 if n <= 400_000_000 else 3
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(radius, agreeing))))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.v")
    crowded = cut_lineage(rows.groupBy("t", "v").count().filter(F.col("count") > shard_rows).withColumn("chunks", F.ceil(F.col("count") / shard_rows).cast("long")).drop("count"))
    zero, both = F.lit(0).cast("long"), F.lit(2).cast("long")
    if crowded.isEmpty():
        return links_in_shards(rows.withColumns({"c": zero, "side": both}), radius)
    roomy = rows.join(crowded, ["t", "v"], "left_anti").withColumns({"c": zero, "side": both})
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # Chunk i meets chunk j once, under the name i * chunks + j with i <= j; i is the tree and j the probes.
    pairs = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda o: F.struct((F.least(o, F.col("own")) * F.col("chunks") + F.greatest(o, F.col("own"))).alias("c"), F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).cast("long").alias("side")))
    split = rows.join(crowded, ["t", "v"]).withColumn("own", own).select("fp", "t", "v", F.explode(pairs).alias("p")).select("fp", "t", "v", "p.c", "p.side")
    return links_in_shards(roomy, radius).union(links_in_shards(split, radius))


def connected(edges: DataFrame) -> DataFrame:
    """u, root (the smallest node reachable) for every node that has an edge: large-star and small-star in turn until nothing changes.

    Nodes and edges stay distributed; the driver sees a count and a checksum a round.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(low, "u")
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return moved.filter(F.col("u") != F.col("v")).distinct()

    edges, before = cut_lineage(edges.filter(F.col("u") != F.col("v")).distinct()), None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select("u", F.col("v").alias("root"))
        before, edges = seen, cut_lineage(star(star(edges, True), False))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, agreeing: int | None = None) -> DataFrame:
    """key, fp, component_id (the smallest key reachable over links, its own included) for every row of `docs`.

    Null and empty texts share the fingerprint zero and are linked like any other. Rows of the same key keep their
    rows. A null key takes part and is never the smallest, unless all keys of the component are null (then null).
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    marked = cut_lineage(fingerprints(docs.select(F.col(quoted(key)).alias("__key"), F.col(quoted(text)).alias("__t")), "__t", ("__key",), shingle))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("__key").alias("low"), F.count("*").alias("rows")))
    return named_components(marked, distinct, connected(links(distinct, radius, agreeing=agreeing)), "fp").select(F.col("__key").alias(key), "fp", "component_id")


def named_components(marked: DataFrame, distinct: DataFrame, stars: DataFrame, node: str) -> DataFrame:
    """marked with root and component_id, the smallest key of the node's component (distinct: node, low, rows; stars: u, root).

    A node or a component that holds many rows is no single task's work.
    """
    rooted = cut_lineage(distinct.join(stars.withColumnRenamed("u", node), node, "left").withColumn("root", F.coalesce("root", node)))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    return by_share(marked, by_share(rooted, lowest, "root", "nodes").select(node, "root", "component_id", "rows"), node, "rows")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the lower-cased shingles; fewer words than `shingle` are one; no word: empty."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    sums = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        sums += hashes[i : i + len(sums)] * ODD[1, i]
    return np.unique(mixed(sums))


def digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def bands(own: np.ndarray) -> list[int]:
    """A key for each band, made of MINIMA minima of the set under different orders."""
    if not own.size:
        return []
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        np.minimum(low, (ODD[0][:, None] * own[None, at : at + 4096]).min(axis=1), out=low)
    keys = (mixed(low) * ODD[2]).reshape(BANDS, MINIMA).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).view(np.int64).tolist()


def wide_simhash(own: np.ndarray) -> np.ndarray:
    """PRINT words: a bit is 1 if it is set in over half the hashes of the set's shingles."""
    counts = np.zeros(64 * PRINT, np.int64)
    for at in range(0, len(own), 4096):
        hashes = mixed(mixed(own[at : at + 4096, None] * SPREAD))
        counts += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)


def bits_apart(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ fp).sum(axis=1, dtype=np.int16)


class BKTree:
    """Of distinct fingerprints of several words; a node hangs under the edge that equals its distance to its parent."""

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        self.fps, self.up, self.edge = fps, np.full(n, -1), np.zeros(n, np.int16)
        self.there, self.below = np.ones(n, bool), np.zeros(n, np.int64)  # what hasn't been dropped, and how much of it lies in a subtree
        subtrees = [np.arange(n)]
        while subtrees:
            members = subtrees.pop()
            root, rest = members[0], members[1:]
            self.below[root] = members.size
            if rest.size:
                far = bits_apart(fps[rest], fps[root])
                order = np.argsort(far, kind="stable")
                rest, far = rest[order], far[order]
                starts = np.flatnonzero(np.append(True, far[1:] != far[:-1]))
                self.up[rest[starts]], self.edge[rest[starts]] = root, far[starts]
                subtrees += np.split(rest, starts[1:])
        self.children = np.argsort(self.up, kind="stable")
        self.first = np.searchsorted(self.up[self.children], np.arange(n + 1))

    def near(self, fp: np.ndarray, radius: int) -> np.ndarray:
        """The nodes within the radius that are still there: level by level, along edges that differ from the distance to the parent by no more than it."""
        found, level = [], np.flatnonzero(self.below[:1])
        while level.size:
            far = bits_apart(self.fps[level], fp)
            found.append(level[(far <= radius) & self.there[level]])
            first, many = self.first[level], self.first[level + 1] - self.first[level]
            at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            level = self.children[at]
            level = level[(self.below[level] > 0) & (np.abs(self.edge[level] - np.repeat(far, many)) <= radius)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def drop(self, nodes: np.ndarray) -> None:
        self.there[nodes] = False
        while nodes.size:
            np.subtract.at(self.below, nodes, 1)
            nodes = self.up[nodes]
            nodes = nodes[nodes >= 0]


def like_edges(names: list[int], sets: list[np.ndarray], prints: list[bytes], like: tuple[int, int] = LIKE, radius: int = STAGE_RADIUS) -> list[tuple[int, int]]:
    """Edges that span the groups of sets whose fingerprints (`prints`) lie within the radius and whose exact Jaccard similarity is `like` or more.

    A set is sought only among those that no group has taken yet, so n copies cost n comparisons. Equal fingerprints are one node of the tree.
    """
    top, bottom = like
    sizes = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    flags = np.zeros(int(ids.max()) + 1, bool)
    number: dict[bytes, int] = {}
    node = np.array([number.setdefault(p, len(number)) for p in prints])
    fps = np.frombuffer(b"".join(number), np.uint64).reshape(len(number), -1)
    tree, holders = BKTree(fps), np.split(np.argsort(node, kind="stable"), np.cumsum(np.bincount(node))[:-1])
    free, open_ = np.ones(len(sets), bool), np.bincount(node)
    edges = []

    def take(found: np.ndarray) -> None:
        free[found] = False
        np.subtract.at(open_, node[found], 1)
        touched = np.unique(node[found])
        tree.drop(touched[open_[touched] == 0])

    for seed in range(len(sets)):
        if not free[seed]:
            continue
        take(np.array([seed]))
        waiting = [seed]
        while waiting:
            one = waiting.pop()
            near = tree.near(fps[node[one]], radius)
            if not near.size:
                continue
            others = np.concatenate([holders[x] for x in near.tolist()])
            others = others[free[others]]
            flags[parts[one]] = True
            common = np.add.reduceat(flags[np.concatenate([parts[x] for x in others.tolist()])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            flags[parts[one]] = False
            found = others[(top + bottom) * common >= top * (sizes[others] + sizes[one])]
            if found.size:
                edges += [(names[i], names[one]) for i in found.tolist()]
                waiting += found.tolist()
                take(found)
    return edges


def like_links(shards: DataFrame, like: tuple[int, int]) -> DataFrame:
    """shards: b, c, sig, set, print (all rows of a pair b, c are one tree). Edges u, v; holds one group at a time."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(names, sets, prints) -> pa.RecordBatch:
            edges = like_edges(names, sets, prints, like) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

        now, names, sets, prints = None, [], [], []
        for batch in stream:
            for b, c, sig, own, fp in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (b, c) != now:
                    if len(names) > 1:
                        yield flush(names, sets, prints)
                    now, names, sets, prints = (b, c), [], [], []
                names.append(sig)
                sets.append(np.frombuffer(own, np.uint64))
                prints.append(fp)
        yield flush(names, sets, prints)

    return shards.select("b", "c", "sig", "set", "print").repartition("b", "c").sortWithinPartitions("b", "c").mapInArrow(work, "u long, v long")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key and component_id (the smallest key reachable over links) for every row of `docs`.

    Rows of the same key keep their rows. A null key takes part and is never the smallest, unless all keys of the
    component are null (then null). Texts without a word are alike. Other columns are ignored.
    """
    source = docs.select(F.col(quoted(key)).alias("__key"), F.col(quoted(text)).alias("__t"))
    return linked_texts(source, **options).select(F.col("__key").alias(key), "component_id")


def linked_texts(source: DataFrame, shingle: int = STAGE_SHINGLE, like: tuple[int, int] = LIKE, shard_shingles: int = 2_000_000) -> DataFrame:
    """All columns of source (__key, __t and more) but the text, with root and component_id of the row's component.

    Equal sets are one node. The fingerprints of nodes that share a band make a BK-tree, once for bands of the same nodes;
    what it finds within STAGE_RADIUS is confirmed on the exact sets. A shard beyond `shard_shingles` is cut into chunks, and each pair of chunks is a task's work.
    """
    long = T.LongType()
    source = source.withColumn("__h", F.xxhash64(F.col("__key").cast("string"), "__t"))

    def start():
        def work(texts):
            sets = [shingles(t, shingle) for t in texts]
            return [[digest(x) for x in sets], [len(x) for x in sets], [bands(x) for x in sets]]

        return work

    marked = cut_lineage(map_texts(source, "__t", tuple(c for c in source.columns if c != "__t"), T.StructType([T.StructField("sig", long), T.StructField("n", long), T.StructField("bands", T.ArrayType(long))]), start, raw=True))
    distinct = cut_lineage(marked.groupBy("sig").agg(F.min("__key").alias("low"), F.min("__h").alias("one"), F.count("*").alias("rows")))
    rows = marked.select("sig", "n", F.explode("bands").alias("b"))
    shared = rows.groupBy("b").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).filter("least < most").select("b")
    members = cut_lineage(rows.join(shared, "b").distinct())
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    alike = members.groupBy("b").agg(F.count("*").alias("rows"), exact(F.xxhash64("sig")).alias("sum"), F.sum("n").alias("total"))
    once = alike.groupBy("rows", "sum").agg(F.min(F.struct("b", "total")).alias("one")).select("one.b", F.ceil(F.col("one.total") / shard_shingles).cast("long").alias("chunks"))
    members = cut_lineage(members.join(once, "b"))

    def again():
        def work(texts):
            sets = [shingles(t, shingle) for t in texts]
            return [[digest(x) for x in sets], [x.tobytes() for x in sets], [wide_simhash(x).tobytes() for x in sets]]

        return work

    # One row of each set is read again; equal rows bring it several times.
    wanted = distinct.join(members.select("sig").distinct(), "sig").select(F.col("one").alias("__h")).distinct()
    sets = map_texts(source.select("__h", "__t").join(wanted, "__h", "left_semi"), "__t", ("__h",), T.StructType([T.StructField("sig", long), T.StructField("set", T.BinaryType()), T.StructField("print", T.BinaryType())]), again, raw=True)
    # Chunk i meets chunk j in the group i * chunks + j with i < j, which holds the rows of both.
    own, chunks, zero = F.pmod(F.xxhash64("sig"), F.col("chunks")), F.col("chunks"), F.lit(0).cast("long")
    groups = F.when(chunks == 1, F.array(zero)).otherwise(F.transform(F.filter(F.sequence(zero, chunks - 1), lambda o: o != F.col("own")), lambda o: F.least(o, F.col("own")) * chunks + F.greatest(o, F.col("own"))))
    placed = members.withColumn("own", own).select("sig", "b", F.explode(groups).alias("c"))
    shards = placed.join(sets.dropDuplicates(["sig"]).select("sig", "set", "print"), "sig")
    stars = connected(like_links(shards, like))
    return named_components(marked.drop("n", "bands", "__h"), distinct.drop("one"), stars, "sig").drop("sig")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without near-duplicates: of each component of similar texts one row stays.

    It is the row of the smallest key, of several such the one whose text and then whose columns together have the
    smallest hash, so reruns agree. Rows of one key with different texts are different documents; equal rows are copies
    of each other. Rows without a key can't be told apart by it; all stay. An empty table gives an empty result.
    """
    plain = lambda f: F.col(quoted(f.name)) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(quoted(f.name)))
    hashes = {"__of_text": F.xxhash64(quoted(text)), "__of_row": F.xxhash64(*map(plain, docs.schema))}
    _, at, back = set_apart(docs)
    inner = docs.select(*(F.col(quoted(c)).alias(n) for c, n in at.items()), *(c.alias(n) for n, c in hashes.items()))
    named = inner.filter(F.col(at[key]).isNotNull())
    found = linked_texts(named.select(F.col(at[key]).alias("__key"), F.col(at[text]).alias("__t"), *hashes), **options)
    first = found.filter(F.col("__key") == F.col("component_id")).groupBy("root").agg(F.min(F.struct(*hashes)).alias("first"))
    kept = named.join(first.select("first.*"), list(hashes), "left_semi").dropDuplicates(list(hashes))
    return kept.unionByName(inner.filter(F.col(at[key]).isNull())).select(*back)


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")
