"""Alignment: equal to both libraries and a plain count, with broadcast and joined lookups; the minimal perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import alignment
from cairn.llm.token_count import tokenizer_file

WORDS = ["the", "don't", "word", "Straße", "<|endoftext|>", "<s>", "日本語", "😀", "12345", "x" * 300, "...", "'ll", "é", "ﬁ", "<0x41>"]
SPACES = [" ", " ", " ", "  ", "\n", "\n\n ", "\t", " ", "　", "\x85", "\r\n", "\x1c ", " ​"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice(SPACES) for _ in range(r.randint(1, 60)))[: r.randint(1, 400)] for _ in range(n)]


@pytest.fixture(scope="module")
def both():
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as a, open(tokenizer_file("piece_bpe_32k.model"), "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def test_segments_give_the_ids_of_whole_texts(both):
    assert both.by_segments and both.fine
    r = random.Random(2)
    plain_ones = ["".join(r.choice(["ab", "Cd", "é", "l'", "d'", ".", ",", "x.y", "n't", "12", "-", "(", ")", "|", "!", ":", "\n", "\n", " ", " ", "  ", "e.g.", "St.", "*"]) for _ in range(r.randint(1, 30))) for _ in range(4000)]
    for t in texts(2000, 1) + plain_ones:
        found = both.pieces(" " + t)
        assert "".join(found) == " " + t
        assert both.joined(" " + t) == (both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)), t
        assert [x and x[:3] for x in both.aligned(found)] == [x and x[:3] for x in (alignment.align(a, b, both.a_bytes, both.b_bytes, s.encode()) for s, (a, b) in zip(found, both.encoded(found), strict=True))]


def plain(rows):
    """doc_id -> the seven results, byte by byte."""
    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = dict(zip(map(chr, same), same, strict=True)) | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in same)}
    made, held = {}, Counter()
    for key, text in rows:
        made[key] = None
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [bytes(table[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            continue
        of = [[n for n, s in enumerate(part) for _ in s] for part in spelled]  # the token of each byte
        links = sorted(set(zip(*of, strict=True)))
        ends = [set(np.cumsum([len(s) for s in part]).tolist()) for part in spelled]
        cuts = sorted(ends[0] & ends[1])
        groups, first = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i[n]) for n in dict.fromkeys(o[first:cut])) for i, o in zip(ids, of, strict=True)))
            first = cut
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        held.update(set(pairs))
        made[key] = len(ids[0]), len(ids[1]), len(groups), pairs, ";".join(groups)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return {k: (0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(held[p] == best[p[0]] for p in m[3]), sum(held[p] for p in m[3]), hashlib.sha256(m[4].encode()).hexdigest()) for k, m in made.items()}


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 0])
def test_documents_equal_a_plain_alignment(spark, pairs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 100)
    rows = list(enumerate([None, "", " ", "  ", "▁", "a ▁ b", "\x00", "word ", "x" * 20_000, "long text " * 3000, *texts(80, 2), *["the same text"] * 40]))
    frame = spark.createDataFrame([(i, t, 1.5, "clash") for i, t in rows], "doc_id long, text string, n_links double, pair string").repartition(5)
    found = alignment.align_documents(frame, keep=("doc_id", "n_links", "pair"), pairs=pairs)
    assert sorted(found.columns) == sorted(["doc_id", "pair", *alignment.RESULTS.names])
    got = {r.doc_id: tuple(r[c] for c in alignment.RESULTS.names) for r in found.collect()}
    assert got == plain(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "`doc.id` long, `a.text` string")
    assert alignment.align_documents(empty, text="a.text", keep=("doc.id",)).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"a\xff b")), (1, bytearray(b"fine")), (None, bytearray(b"fine"))], "`doc.id` long, raw binary").select("`doc.id`", F.col("raw").cast("string").alias("a.text"))
    for pairs in (alignment.PAIRS, 0):
        got = sorted((r.n_a, r.n_best, r.count_sum, r.groups_sha256 != "") for r in alignment.align_documents(broken, text="a.text", keep=("doc.id",), pairs=pairs).collect())
        assert got == [(0, 0, 0, False), (1, 1, 2, True), (1, 1, 2, True)]


def test_perfect_hash_is_minimal_and_verified(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 500)
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 9000))
    places = alignment.perfect_hash(spark.createDataFrame([(int(k),) for k in keys], "pair long"), len(keys))
    assert sorted(places.of(keys.view(np.uint64)).tolist()) == list(range(len(keys)))
    assert places.of(np.array([12345], np.uint64)).tolist() == [-1]
    with pytest.raises(RuntimeError, match="changed"):
        alignment.known(places.of(np.array([12345], np.uint64)))


def test_links_keep_their_ids():
    narrow, wide = np.array([[0, 5], [65535, 65535], [0, 0]], np.int64), np.array([[70000, 5], [3, 1 << 20]], np.int64)
    for ids, packed in ((narrow, (narrow[:, 0] << 16 | narrow[:, 1]).astype(np.uint32).tobytes()), (wide, (wide[:, 0] << 32 | wide[:, 1]).tobytes() + b"\0"), (narrow[:0], b""), (narrow[:0], b"\0")):
        assert alignment.links_of(packed).tolist() == [a << 32 | b for a, b in ids.tolist()]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 0])
def test_each_text_is_read_and_encoded_once(spark, pairs):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(i):
        seen.add(1)
        return f"row {i} of a text, read once"

    docs = spark.range(40).select(F.col("id").alias("links"), counted("id").alias("text"))
    got = alignment.align_documents(docs, keep=("links",), pairs=pairs).collect()
    assert seen.value == 40 and sorted(r.links for r in got) == list(range(40)) and all(r.n_links >= r.n_groups > 0 for r in got)
