"""Exact deduplication: equal to a dictionary of the normalised bytes, whatever the block size, and on odd tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup


def plain(rows):
    """doc_id -> (keep_id, group_size) of distinct, non-null ids."""
    groups = {}
    for key, text in rows:
        groups.setdefault(normal(text), []).append(key)
    return {k: (max(g), len(g), k == max(g)) for g in groups.values() for k in g}


def normal(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.mark.parametrize("size", [50, 4096])
def test_groups_equal_a_dictionary(spark, size):
    r = random.Random(size)
    base = ["", "a", "É" * 100, "the same text " * 40, "x" * 4096, "x" * 4097, "ab" * 4096, "word " * 2000]
    texts = [None, *base]
    for t in base * 6:
        at = r.randrange(len(t) + 1)
        texts.append(r.choice((t, t.swapcase() if t.isascii() else t.replace("É", "é", 1), t[:at], t[:at] + "Q" + t[at:], t + t)))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "clash", "k") for i, t in rows], "doc_id long, text string, name string, key string").repartition(5)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame, size=size).collect()}
    assert {k: (x.keep_id, x.group_size, x.kept) for k, x in got.items()} == plain(rows)
    assert all(got[i].text_sha256 == hashlib.sha256(normal(t)).hexdigest() for i, t in rows)


def test_repeated_and_null_keys(spark):
    frame = spark.createDataFrame([(1, "A"), (1, "a"), (None, "a"), (None, "none"), (None, "NONE"), (2, None)], "`doc.id` long, `a text` string")
    got = sorted(map(tuple, exact_dedup.exact_groups(frame, "doc.id", "a text").drop("text_sha256").collect()), key=str)
    assert got == sorted([(1, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (None, None, 2, False), (None, None, 2, True), (2, 2, 1, True)], key=str)
    assert exact_dedup.exact_groups(frame.limit(0), "doc.id", "a text").count() == 0


def test_broken_bytes_stay_apart(spark):
    raw = spark.createDataFrame([(1, bytearray(b"A\xff b\xc3")), (2, bytearray(b"a\xfe b\xc3")), (3, bytearray(b"a\xff b\xc3"))], "doc_id long, raw binary")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(raw.select("doc_id", F.col("raw").cast("string").alias("text"))).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_blocks_of_one_key_are_told_apart(spark, monkeypatch):
    """Where hashes collide, other seeds are tried."""
    honest, seeds = exact_dedup.key_of, []

    def colliding(block, seed):
        seeds.append(seed)
        return honest(F.lit("same") if seed == 42 else block, seed)

    monkeypatch.setattr(exact_dedup, "key_of", colliding)
    frame = spark.createDataFrame([(1, "one"), (2, "two"), (3, "ONE")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(frame).collect()} == {1: 3, 2: 2, 3: 3}
    assert {42, 43} <= set(seeds)


def test_a_hot_text_of_many_blocks(spark):
    rows = [(i, "hot " * 500 if i % 3 else f"text {i} " * 300) for i in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=256)
    assert got.filter("kept").count() == 201 and got.agg(F.max("group_size")).first()[0] == 400
