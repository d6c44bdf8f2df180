"""Alignment of two tokenizers' tokens, and how many documents link each pair of their ids.

A text is cut into segments at which both tokenizers cut: before a space that follows a visible character, in plain texts
around a line end and before a stop that follows a letter too. A worker encodes, aligns and remembers segments, so a text
costs a lookup a segment. One pass aligns every text and keeps its links (4 bytes each, in the checkpoints' folder); all
else reads these. Tasks sum up how many documents hold a pair. A minimal perfect hash over the distinct pairs, built in
shards, gives each pair a place of its own in a dense vector; tasks add their counts up in such vectors and these in a
tree. The pairs themselves lie at their places too, so every lookup is verified. A last pass looks the links' counts up.

The hash, pairs and counts are broadcast as long as there are at most PAIRS pairs; beyond that, pairs are counted and
looked up by joins, with the same result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Pieces, is_plain
from .shared import by_share, cut_lineage, map_texts, quoted, read, slices, tree_sum
from .token_count import tokenizer_file

#: Pairs that are broadcast, at most (21 bytes each); pairs of a shard of the hash; bits of the hash a pair and level;
#: numbers of a block of a dense vector; pairs that a task counts before it hands them on; segments that a worker keeps.
PAIRS, SHARD, LOAD, BLOCK, COUNTED, KEPT = 1 << 24, 1 << 16, 2, 1 << 16, 1 << 19, 400_000
#: Bytes of texts that are looked up together.
PART = 1 << 20

#: White space and format characters, on which engines differ.
UNSEEN = "[\\s\\x00-\\x1f\\x7f-\\xa0\\xad\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]"
#: Spaces and what follows them up to the next space; on, where that ends unseen, for only after a visible character do
#: both tokenizers cut.
SEGMENT = re.compile(f"(?s) +[^ ]*(?:(?<={UNSEEN}) +[^ ]*)*")
ENDS_UNSEEN = re.compile(UNSEEN).match
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?)]}|\"*"
OTHER_SPACE = re.compile(r"[^\S \n]").search
PROBES = ("Word, word", "a  b   c ", " x\n y\t z\r\n", "AB12cd!? 42 - 'tis", "Été 日本 語 😀 ok", "<s> ▁ <|endoftext|> <0x41>", "\n", "don't  ", "One, two.\nThree (four); x.y \n\n five!\n", "a|b ...c. .d\n.e\n f")


# --- encoding and aligning ---


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both libraries, and the bytes of each id. a_definition: of a byte-level BPE; b_model: a sentencepiece model."""

    def __init__(self, a_definition: str, b_model: bytes):
        import sentencepiece

        from .pretokens import load

        self.a = load(a_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        at = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(at.__getitem__, token)) if all(c in at for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # Segments may be encoded each for itself if no piece reaches over a cut, and the probes agree.
        inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.by_segments, self.fine = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces), None
        letters = [c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)]
        stops = re.escape("".join(c for c in STOPS if not any(x + c in inside for x in letters)))
        self.by_segments = self.by_segments and self.agrees()
        if self.by_segments and stops:
            self.fine = re.compile(rf"\n(?=[^ \n])|[ \n]*(?:[^ \n{LETTERS}]+|[{LETTERS}]++(?![{stops}]))*+[{LETTERS}]*")
            self.fine = self.fine if self.agrees() else None

    def agrees(self) -> bool:
        return all(self.joined(" " + p) == tuple(map(list, self.whole(" " + p))) for p in PROBES)

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1)

    def encoded(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both id lists of each segment. The second library adds a space by itself: it takes that of a segment which
        begins with one, and is dropped with a line end in front of others."""
        first = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        second = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        return [(a, b[2:] if s[0] != " " else [self.space] if s == " " else b) for s, a, b in zip(segments, first, second, strict=True)]

    def pieces(self, text: str) -> list[str]:
        """The segments of a text that begins with a space."""
        if not self.by_segments:
            return [text]
        if self.fine is not None and is_plain(text) and not OTHER_SPACE(text):
            return list(filter(None, self.fine.findall(text)))
        return SEGMENT.findall(text)

    def joined(self, text: str) -> tuple[list[int], list[int]]:
        made = self.encoded(self.pieces(text))
        return [i for a, _ in made for i in a], [i for _, b in made for i in b]

    def cut(self, text: bytes | None) -> list[str] | None:
        """The segments of space and text; None where there is no text or it isn't UTF-8."""
        try:
            known = (text or b"").decode()
        except UnicodeDecodeError:
            return None
        return self.pieces(" " + known) if known else None

    def aligned(self, segments: list[str]) -> list[tuple[int, int, int, str, list[int]] | tuple]:
        """n_a, n_b, n_groups, the groups' text and the linked pairs (a << 32 | b) of each; () where bytes differ."""
        side = [s for s in segments if not self.by_segments or "▁" in s or "\n" in s or s[:2] == "  " or ENDS_UNSEEN(s[-1])]
        apart = set(side)
        rest = [s for s in segments if s not in apart]
        found = dict(zip(rest, self.side_by_side(rest) or (), strict=False))
        if len(found) < len(rest):
            side, found = segments, {}
        found.update((s, align(a, b, self.a_bytes, self.b_bytes, s.encode())) for s, (a, b) in zip(side, self.encoded(side), strict=True))
        return [found[s] for s in segments]

    def side_by_side(self, segments: list[str]) -> list[tuple[int, int, int, str, list[int]]] | None:
        """The same for segments that may stand in lines of their own in one text, which the libraries encode at once; None if it isn't spelled."""
        if not segments:
            return []
        segments = [x for s in segments for x in ("\n", s)]
        text = "".join(segments)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        b = np.array(self.b.encode(text, num_threads=1)[1:])  # without the space that is added
        whole = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        a_end, b_end = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        ends = np.cumsum([len(s.encode()) for s in segments])
        merged = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        twice = np.append(merged[1:] == merged[:-1], False)
        cuts, spans = merged[twice], merged[~twice]
        if (cuts[np.minimum(np.searchsorted(cuts, ends), len(cuts) - 1)] != ends).any():
            return None
        # Between two ends of tokens lies the overlap of one pair.
        pairs = (a[np.searchsorted(a_end, spans)] << 32 | b[np.searchsorted(b_end, spans)]).tolist()
        upto = [[0, *np.searchsorted(x, ends, "right").tolist()] for x in (a_end, b_end, cuts, spans)]
        names, others = list(map(str, a.tolist())), list(map(str, b.tolist()))
        edges = ([0, *np.searchsorted(x, cuts, "right").tolist()] for x in (a_end, b_end))
        groups = [",".join(names[i:j]) + "|" + ",".join(others[k:m]) for (i, j), (k, m) in zip(*map(itertools.pairwise, edges), strict=True)]
        return [(a1 - a0, b1 - b0, g1 - g0, ";".join(groups[g0:g1]), pairs[p0:p1]) for (a0, a1), (b0, b1), (g0, g1), (p0, p1) in itertools.islice(zip(*map(itertools.pairwise, upto), strict=True), 1, None, 2)]


def align(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes], whole: bytes) -> tuple:
    if b"".join(map(a_bytes.__getitem__, a)) != whole or b"".join(map(b_bytes.__getitem__, b)) != whole:
        return ()
    pairs, groups = [], []
    i = j = first_i = first_j = 0
    a_end, b_end = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        pairs.append(a[i] << 32 | b[j])
        more_a, more_b = a_end <= b_end, b_end <= a_end
        if more_a:
            i += 1
        if more_b:
            j += 1
        if more_a and more_b:
            groups.append(",".join(map(str, a[first_i:i])) + "|" + ",".join(map(str, b[first_j:j])))
            first_i, first_j = i, j
            if i == len(a):
                return len(a), len(b), len(groups), ";".join(groups), pairs
        if more_a:
            a_end += len(a_bytes[a[i]])
        if more_b:
            b_end += len(b_bytes[b[j]])


class Shared:
    """What is broadcast; a worker process builds its tokenizers once, and remembers segments from task to task."""

    def __init__(self, a_definition: str, b_model: bytes):
        self.files = a_definition, b_model

    def __reduce__(self):
        return Shared, self.files

    @functools.cached_property
    def tokenizers(self) -> Tokenizers:
        return Tokenizers(*self.files)


    @functools.cached_property
    def segments(self) -> Pieces:
        """n_a, n_b, n_groups, n_links, the groups' text and the links (of `wide` tokenizers 8 bytes each, else 4) of each segment."""

        def made(segments: list[str]) -> list[tuple]:
            aligned = self.tokenizers.aligned(segments)
            links = np.array([p for a in aligned if a for p in a[4]], np.int64)
            packed, width = (links.tobytes(), 8) if self.wide else ((links >> 32 << 16 | links & 0xFFFF).astype(np.uint32).tobytes(), 4)
            ends = np.cumsum([width * len(a[4]) if a else 0 for a in aligned]).tolist()
            return [a and (*a[:3], len(a[4]), a[3], packed[end - width * len(a[4]) : end]) for a, end in zip(aligned, ends, strict=True)]

        return Pieces(made, size=KEPT)

    @functools.cached_property
    def wide(self) -> bool:
        return max(len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)) > 1 << 16


def links_of(packed: bytes) -> np.ndarray:
    """The pairs (a << 32 | b) of a text's links: 4 bytes each, or 8 each and one byte more."""
    if len(packed) % 4:
        return np.frombuffer(packed, np.int64, len(packed) // 8)
    short = np.frombuffer(packed, np.uint32).astype(np.int64)
    return short >> 16 << 32 | short & 0xFFFF


# --- the minimal perfect hash ---


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 1 << 16) % np.uint64(shards)).astype(np.int64)


def levels_of(keys: np.ndarray) -> list[np.ndarray]:
    """Bits by level: a key that is alone at its place of a level is settled there, the others go to the next."""
    levels, left = [], keys
    while left.size:
        size = 64 * -(-LOAD * left.size // 64)
        at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 1000:
            raise RuntimeError("the pairs of a shard aren't distinct")
    return levels


class Places:
    """pair -> its place among all distinct pairs, from the shards' levels laid end to end; every answer is verified."""

    def __init__(self, shards: list[tuple[list[np.ndarray], np.ndarray]]):
        """(levels, keys) of each shard, in order."""
        self.shards, depth = len(shards), max((len(s[0]) for s in shards), default=0)
        self.words, self.before, self.first, self.size, n = [], [], [], [], 0
        for level in range(depth):
            bits = [s[0][level] if level < len(s[0]) else np.zeros(0, bool) for s in shards]
            sizes = np.array([len(b) for b in bits])
            words = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(n + np.cumsum(ones) - ones)
            self.first.append(np.cumsum(sizes) - sizes)
            self.size.append(sizes)
            n += int(ones.sum())
        keys = np.concatenate([s[1] for s in shards]) if shards else np.zeros(0, np.uint64)
        self.keys = np.zeros(n, np.uint64)
        self.keys[known(self.unverified(keys))] = keys

    def unverified(self, keys: np.ndarray) -> np.ndarray:
        place, open_ = np.full(len(keys), -1), np.arange(len(keys))
        shard = shard_of(keys, self.shards)
        for level, words in enumerate(self.words):
            size = self.size[level][shard[open_]]
            able = size > 0
            at = self.first[level][shard[open_]] + (mixed(keys[open_], level) % np.maximum(size, 1).astype(np.uint64)).astype(np.int64)
            at[~able] = 0
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = able & ((word >> bit) & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            place[open_[hit]] = (self.before[level][at >> 6] + lower)[hit]
            open_ = open_[~hit]
        return place

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places; -1 for a key that isn't one of the pairs."""
        if not self.keys.size:
            return np.full(len(keys), -1)
        place = self.unverified(keys)
        return np.where(self.keys[place] == keys, place, -1)


def known(place: np.ndarray) -> np.ndarray:
    if (place < 0).any():
        raise RuntimeError("a pair that the first pass didn't see: the documents changed meanwhile")
    return place


def perfect_hash(pairs: DataFrame, n: int) -> Places:
    """Of n distinct pairs (n at most PAIRS, so that the hash fits the driver); a task builds one shard at a time."""
    shards = max(1, -(-n // SHARD))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(group.pair.to_numpy().view(np.uint64))
        levels = levels_of(keys)
        return pd.DataFrame({"shard": [int(group.shard.iloc[0])], "sizes": [[len(x) for x in levels]], "bits": [np.packbits(np.concatenate(levels), bitorder="little").tobytes()], "pairs": [keys.tobytes()]})

    @F.pandas_udf(T.LongType())
    def shard(pair: pd.Series) -> pd.Series:
        return pd.Series(shard_of(pair.to_numpy().view(np.uint64), shards))

    rows = {r.shard: r for r in pairs.withColumn("shard", shard("pair")).groupBy("shard").applyInPandas(build, "shard long, sizes array<int>, bits binary, pairs binary").collect()}
    made = []
    for i in range(shards if n else 0):
        if i not in rows:
            made.append(([], np.zeros(0, np.uint64)))
            continue
        bits = np.unpackbits(np.frombuffer(rows[i].bits, np.uint8), bitorder="little").astype(bool)
        made.append((np.split(bits, np.cumsum(rows[i].sizes)[:-1]), np.frombuffer(rows[i].pairs, np.uint64)))
    return Places(made)


# --- counts ---


def added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def partial_counts(rows: DataFrame) -> DataFrame:
    """pair, n: in how many rows (links) of a part of a task the pair is linked."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = counts = np.zeros(0, np.int64)
        for batch in stream:
            for part in slices(batch, PART):
                each = [np.unique(links_of(x)) for x in part.column(0).to_pylist() if x]
                if each:
                    new = np.unique(np.concatenate(each), return_counts=True)
                    pairs, counts = added([pairs, new[0]], [counts, new[1]])
                if len(pairs) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                    pairs = counts = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    return rows.select("links").mapInArrow(work, "pair long, n long")


def dense_counts(partial: DataFrame, places: Places) -> np.ndarray:
    """The counts of all pairs by place: dense vectors of a task's pairs, in blocks, added up in a tree."""
    spark, n = partial.sparkSession, len(places.keys)
    shared = spark.sparkContext.broadcast(places)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BLOCK * -(-n // BLOCK), np.int64)
        for batch in stream:
            pairs, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(dense, known(shared.value.of(pairs.view(np.uint64))), counts)
        part = TaskContext.get().partitionId()
        for at in range(0, n, BLOCK):
            block = dense[at : at + BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([block], pa.list_(pa.int64()))], names=["part", "at", "values"])

    # A task takes many parts of the first pass, so vectors are as many as cores and not as parts.
    blocks = tree_sum(partial.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(work, "part long, at long, values array<long>"))
    shared.destroy()
    return np.concatenate([blocks[at] for at in range(0, n, BLOCK)])[:n] if n else np.zeros(0, np.int64)


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULTS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups_sha256", T.StringType())])


LINKED = T.StructType([*RESULTS.fields[:4], RESULTS["groups_sha256"], T.StructField("links", T.BinaryType())])


def linked(docs: DataFrame, text: str, keep: tuple[str, ...], shared) -> DataFrame:
    """`keep`, what doesn't depend on the counts, and the links of each text: the only pass that encodes."""

    def start() -> Callable:
        tokenizers, segments, end = shared.value.tokenizers, shared.value.segments, b"\0" if shared.value.wide else b""

        def work(texts: list[bytes | None]) -> list[tuple]:
            cuts, rows = [tokenizers.cut(t) for t in texts], []
            for cut, values in zip(cuts, segments.look_up([c or [] for c in cuts]), strict=True):
                if not cut or () in values:
                    rows.append((0, 0, 0, 0, "", b""))
                    continue
                *sums, groups, links = zip(*values, strict=True)
                rows.append((*map(sum, sums), hashlib.sha256(";".join(groups).encode()).hexdigest(), b"".join(links) + end))
            return list(zip(*rows, strict=True))

        return work

    return map_texts(docs, text, keep, LINKED, start, PART, raw=True)


def looked_up(rows: DataFrame, places: Places, counts: np.ndarray) -> DataFrame:
    """rows with n_best and count_sum, where hash, pairs and counts are broadcast."""
    first = (places.keys >> np.uint64(32)).astype(np.int64)
    highest = np.zeros(int(first.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, first, counts)
    tables = rows.sparkSession.sparkContext.broadcast((places, smallest(counts), counts == highest[first]))

    def start() -> Callable:
        places, counts, best = tables.value

        def work(texts: list[bytes]) -> list[np.ndarray]:
            links = list(map(links_of, texts))
            place = known(places.of(np.concatenate(links).view(np.uint64)))
            ends = np.cumsum([0, *map(len, links)])
            return [np.diff(np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[ends]) for x in (best, counts)]

        return work

    return map_texts(rows, "links", tuple(c for c in rows.columns if c != "links"), T.StructType(RESULTS.fields[4:6]), start, PART, raw=True)


def joined(rows: DataFrame, partial: DataFrame) -> DataFrame:
    """The same by joins, where the pairs are too many to be broadcast."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, PART):
                row, packed = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
                each = [np.unique(links_of(x), return_counts=True) for x in packed]
                made = np.repeat(row, [len(e[0]) for e in each]), *(np.concatenate([e[i] for e in each]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["__row", "pair", "times"])

    rows = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    counts = cut_lineage(partial.groupBy("pair").agg(F.sum("n").alias("count")))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    facts = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", F.col("count").alias("documents"), (F.col("count") == F.col("highest")).alias("best"))
    # A pair that a large part of the documents hold is looked up in a broadcast of such pairs.
    found = by_share(rows.select("__row", "links").mapInArrow(work, "__row long, pair long, times long"), facts, "pair", "documents")
    sums = found.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return rows.drop("links").join(sums, "__row", "left").fillna(0, ["n_best", "count_sum"])


def align_documents(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pairs: int = PAIRS) -> DataFrame:
    """`keep` and, for every row: n_a and n_b (tokens), n_groups (runs of bytes between offsets at which tokens of both
    end), n_links (pairs of tokens whose bytes overlap), n_best (links whose pair of ids is linked in as many documents
    as any pair of its a id), count_sum (over links, the number of documents that link the pair) and groups_sha256.

    a_file: a byte-level BPE of the tokenizers library; b_file: a sentencepiece model that adds a space. Each row is a
    document, repeated rows too. Rows have zeros and '' whose text is null, empty or not UTF-8, or whose tokens don't
    spell it. Texts are aligned whole. An empty table gives an empty result. Kept columns of the results' names give
    way to them. Up to `pairs` distinct pairs are broadcast; more are joined.
    """
    with open(a_file or tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as a, open(b_file or tokenizer_file("piece_bpe_32k.model"), "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast(Shared(a.read(), b.read()))
    names = {c: f"__keep_{i}" for i, c in enumerate(dict.fromkeys(keep)) if c not in RESULTS.names}
    source = docs.select(F.col(quoted(text)).alias("__text"), *(F.col(quoted(c)).alias(n) for c, n in names.items()))
    rows = cut_lineage(linked(source, "__text", tuple(names.values()), shared))
    partial = cut_lineage(partial_counts(rows))
    distinct = partial.select("pair").distinct()
    n = distinct.count()
    if n > pairs:
        found = joined(rows, partial)
    else:
        places = perfect_hash(distinct, n)
        found = looked_up(rows, places, dense_counts(partial, places))
    return found.select(*(F.col(n).alias(c, metadata=docs.schema[c].metadata) for c, n in names.items()), *RESULTS.names)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
