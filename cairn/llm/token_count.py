"""Exact token counts by a map-side two-tier lookup.

A text is cut into pre-tokens where the tokenizer cuts, and their token counts add up to the text's. Tier one is a
broadcast table with the lengths of frequent pre-tokens, of at most 2 * FREQUENT entries; tier two is a cache in each
worker, which asks the tokenizer library for what a batch of texts misses. No pre-token is shuffled: the table is made of
the words of at most about SAMPLE rows, which reach the driver summed up in their tasks, and what it lacks costs a
cache entry, never a wrong count. Counts equal the library's for every text, because a pre-token is encoded by the
library itself and texts that the cuts don't fit go to it whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Pieces, is_plain, load
from .shared import map_texts, read, utf8

#: Words of the broadcast table (each with and without a space before it), rows that they are taken from, words that a
#: task hands on, the longest word in the table, and bytes of text whose pre-tokens are looked up together.
FREQUENT, SAMPLE, SUMMARY, LONGEST, PART = 1 << 14, 2_000, 512, 64, 1 << 18

#: A word with one space before it; white space up to the last character before a word; that last character.
PIECES = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: The pre-tokenizer's cuts of a plain text; texts that tell whether a tokenizer cuts so.
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
PROBES = ("Word, word", "AB12cd!? 42", "Été-3", "x_y/z", "(a)[b]{c}", "a&b#$%+=~^`|\\\"<>@*:;.,", "Don't they'LL 'tis !'s", "a  b\n\tc \n", "  x")
#: A part that is no white space: between line ends it is cut as anywhere.
SIMPLE = re.compile(r" ?[^ \t-\r]+")
#: White space and format characters beyond those six, on which regular-expression engines differ.
UNUSUAL = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths:
    """Numbers of tokens of whole texts: the broadcast table first, then this worker's cache, then the library.

    Where the tokenizer cuts plain texts into letters, digits, punctuation and white space (PROBES tell), these are
    looked up part by part. Other texts are cut at white space; those with unusual characters or special tokens, and
    all texts of a tokenizer that cuts otherwise, are encoded whole.
    """

    def __init__(self, definition: str, frequent: dict[str, int]):
        self.tokenizer = load(definition)
        self.pieces = Pieces(self.encode, frequent)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.line_end, self.by_parts = self.tokenizer.encode("\n", add_special_tokens=False).ids, False
        self.by_parts = all(self.whole([p])[0] == sum(self.whole(PARTS.findall(p))) for p in PROBES)

    def whole(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, pieces: list[str]) -> list[int]:
        """Plain parts in one go, a line each; what isn't plain each for itself."""
        simple = [p for p in pieces if is_plain(p) and SIMPLE.fullmatch(p)]
        known = {}
        if self.by_parts and simple and len(self.line_end) == 1:
            made = np.array(self.tokenizer.encode_batch_fast(["\n".join(simple)], add_special_tokens=False)[0].ids)
            at = np.flatnonzero(made == self.line_end[0])
            if len(at) == len(simple) - 1:
                known = dict(zip(simple, (np.diff(np.concatenate([[-1], at, [len(made)]])) - 1).tolist(), strict=True))
        others = [p for p in pieces if p not in known]
        known |= zip(others, self.whole(others), strict=True)
        return [known[p] for p in pieces]

    def cut(self, text: str) -> list[str] | None:
        """The parts that are looked up; None: the text goes whole."""
        if not self.by_parts:
            return None
        if is_plain(text):
            return PARTS.findall(text)
        if UNUSUAL.search(text) or any(s in text for s in self.specials):
            return None
        return [part for w in PIECES.findall(text) for part in (PARTS.findall(w) if is_plain(w) else (w,))]

    def of(self, texts: list[bytes | None]) -> list[int]:
        read_ = [(t or b"").decode() for t in texts]
        cuts = list(map(self.cut, read_))
        whole = iter(self.whole([t for t, c in zip(read_, cuts, strict=True) if c is None]))
        counted = self.pieces.look_up([c or [] for c in cuts])
        return [next(whole) if c is None else sum(n) for c, n in zip(cuts, counted, strict=True)]


class Table:
    """What is broadcast; a worker process builds its lookup once, however many tasks it runs."""

    def __init__(self, definition: str, frequent: dict[str, int]):
        self.definition, self.frequent = definition, frequent

    @functools.cached_property
    def lengths(self) -> Lengths:
        return Lengths(self.definition, self.frequent)


def frequent_words(docs: DataFrame, text: str, rows: int = SAMPLE) -> list[str]:
    """The most frequent words of about `rows` rows, drawn evenly from all. A task hands on its SUMMARY most frequent words."""

    def summaries(stream):
        total: Counter = Counter()
        for batch in stream:
            for t in batch.column(0):
                total.update((t.as_py() or b"").split())
        top = [(w.decode(), n) for w, n in total.most_common(SUMMARY) if len(w) < LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    drawn = docs.select(utf8(text).alias("t")).sample(min(1.0, rows / max(1, docs.count())), seed=42)
    total: Counter = Counter()
    for r in drawn.mapInArrow(summaries, "word string, n long").collect():  # at most about rows * SUMMARY words
        total[r.word] += r.n
    return sorted(total, key=lambda w: (-total[w], w))[:FREQUENT]


def token_counts(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes and n_tokens of every row. tokenizer: path of a byte-level BPE definition for the tokenizers library.

    A null text counts as empty: 0 bytes and 0 tokens. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows are counted each; an empty table gives an empty
    result. Kept columns named n_bytes or n_tokens give way to the results.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer or tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    lengths = Lengths(definition, {})
    parts = dict.fromkeys(p for word in frequent_words(docs, text) for piece in (word, " " + word) for p in lengths.cut(piece) or ())
    frequent = dict(zip(parts, lengths.encode(list(parts)), strict=True))
    shared = spark.sparkContext.broadcast(Table(definition, frequent))

    def start():
        lengths = shared.value.lengths
        return lambda texts: ([len(t or b"") for t in texts], lengths.of(texts))

    return map_texts(docs, text, keep, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]), start, PART)


def op5(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > limit)
