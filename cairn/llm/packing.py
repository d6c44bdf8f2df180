"""Cost-balanced packing of token ids into fixed-length training sequences.

Each task packs its own documents, in windows of bounded size, so nothing is shuffled. In a window the pieces go, in
descending order of cost, to the sequence of lowest cost with remaining capacity; a piece's cost is linear plus
quadratic in its length (attention within the piece). Pieces that fit nowhere are cut. Sequences are filled to the
last token: what a window holds over a multiple of the sequence length waits for the next window, and at a task's end
it goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .pretokens import Pieces, is_plain, load
from .shared import give_back, quoted, read, slices, small_batches, utf8
from .token_count import tokenizer_file

SEQUENCE, END = 4096, 2
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Sequences of a window; bytes of text whose pre-tokens are looked up together (they should fit into a core's cache).
WINDOW, PART = 256, 1 << 18

Piece = tuple[int, int, int]  # the document's position in the window, start, length


#: The pre-tokenizer's cuts of a plain text in lower case; texts that tell whether a tokenizer cuts so.
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
PROBES = ("Word,", "AB12cd!?", "Été-3", "x_y/z", "(a)[b]{c}", "a&b#$%+=~^`|\\\"<>@*:;.,", "Don't they'LL 'tis !'s", "a  b\n\tc")


class Ids:
    """The ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words in turn. Where
    it lower-cases and cuts plain texts into letters, digits and punctuation (PROBES tell), these are looked up part by
    part: `Word,` and `word.` share an entry.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.pieces, self.by_parts = Pieces(self.encode), False
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocabulary = tokenizer.get_vocab()
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.by_parts = all(self.whole([p])[0] == b"".join(self.whole(PARTS.findall(p.lower()))) for p in PROBES)

    def whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Plain parts in one go, side by side; what isn't plain each for itself."""
        simple = [p for p in pieces if self.by_parts and is_plain(p)]
        if not simple:
            return self.whole(pieces)
        made = np.array(self.tokenizer.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (1 + np.flatnonzero(self.ends[made]))
        if len(ends) != len(simple):
            return self.whole(pieces)
        ids = made.tobytes()
        known = dict(zip(simple, (ids[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])), strict=True))
        others = [p for p in pieces if p not in known]
        known |= zip(others, self.whole(others), strict=True)
        return [known[p] for p in pieces]

    def cut(self, text: bytes | None) -> list[str]:
        if not text:
            return []
        plain = text.decode()
        if not self.by_parts:
            return [w.decode() for w in text.split()]
        if is_plain(plain):
            return PARTS.findall(plain.lower())
        return [part for w in map(bytes.decode, text.split()) for part in (PARTS.findall(w.lower()) if is_plain(w) else (w,))]

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        return list(map(b"".join, self.pieces.look_up(list(map(self.cut, texts)))))


@functools.lru_cache(maxsize=2)
def ids_of(definition: str) -> Ids:
    """One cache for each worker process, however many tasks it runs."""
    return Ids(load(definition))


def room_for(total: int, length: int, last: bool) -> list[int]:
    """Lengths of the sequences that `total` tokens fill without padding; but for the last window, only whole ones."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if last and rest >> b & 1]


def pack(pieces: list[Piece], room: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[Piece]]:
    """(each sequence's pieces in order, what found no room)."""
    free, costs = np.array(room, np.int64), np.zeros(len(room))
    filled: list[list[Piece]] = [[] for _ in room]

    def lowest(least: int) -> int | None:
        fits = np.flatnonzero(free >= least)
        return int(fits[costs[fits].argmin()]) if fits.size else None

    def put(at: int, piece: Piece) -> None:
        filled[at].append(piece)
        free[at] -= piece[2]
        costs[at] += linear * piece[2] + quadratic * piece[2] ** 2

    odd, over = [], []
    for piece in sorted(pieces, key=lambda p: (-p[2], p)):
        if (at := lowest(piece[2])) is None:
            odd.append(piece)
        else:
            put(at, piece)
    for doc, start, n in odd:
        while n and (at := lowest(1)) is not None:
            take = min(n, int(free[at]))
            put(at, (doc, start, take))
            start, n = start + take, n - take
        if n:
            over.append((doc, start, n))
    return filled, over


def pack_stream(docs: Iterator[tuple[object, bytes]], length: int, linear: float, quadratic: float) -> Iterator[tuple[object, bytes, int, int, int, int]]:
    """(key, ids of the piece, start, the document's tokens, sequence, offset) from (key, ids), a window at a time."""
    held: dict[int, tuple[object, bytes]] = {}
    pieces: list[Piece] = []
    total = sequence = 0

    def flush(last: bool) -> Iterator[tuple[object, bytes, int, int, int, int]]:
        nonlocal pieces, total, sequence, held
        filled, over = pack(pieces, room_for(total, length, last), linear, quadratic)
        for row in filled:
            offset = 0
            for doc, start, n in row:
                key, ids = held[doc]
                yield key, ids[4 * start : 4 * (start + n)], start, len(ids) // 4, sequence, offset
                offset += n
            sequence += 1
        pieces, total = over, sum(p[2] for p in over)
        held = {p[0]: held[p[0]] for p in over}

    for doc, (key, ids) in enumerate(docs):
        held[doc], n = (key, ids), len(ids) // 4
        for start in range(0, n, length):
            pieces.append((doc, start, min(length, n - start)))
        total += n
        if total >= WINDOW * length:
            yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end: int | None = END, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: path of a definition for the tokenizers library whose pre-tokenizer drops white space. `end` is put
    after each document. A null text counts as empty (just `end`; without `end` an empty document has no piece). Null
    and repeated keys keep their rows. Bytes that aren't UTF-8 count as U+FFFD. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(quoted(key)).alias("key"), utf8(text).alias("text"))
    whole = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([source.schema["key"], *whole, T.StructField("ids", T.BinaryType())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(definition.value)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        kind = to_arrow_type(schema["key"].dataType)

        def documents() -> Iterator[tuple[object, bytes]]:
            for batch in stream:
                for part in slices(batch, PART):
                    for k, found in zip(part.column(0).to_pylist(), ids.of(part.column(1).to_pylist()), strict=True):
                        yield k, found + tail

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            keys, ids, start, tokens, sequence, offset = zip(*rows, strict=True)
            out = [pa.array(keys, kind), pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(tokens, pa.int64()), pa.array([first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        rows: list[tuple] = []
        for row in pack_stream(documents(), length, linear, quadratic):
            rows.append(row)
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
        give_back()

    return source.mapInArrow(work, schema).withColumnRenamed("key", key)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
