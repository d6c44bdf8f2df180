"""The corpus registry: names, and the SQL twins."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import registry


def test_one_query_for_each_operator():
    assert sorted(int(m[1]) for n in registry.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    relation = connection.sql(registry.ORACLE_SQL[name])
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(relation.columns)
    assert sorted(frame.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in frame.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in relation.fetchall())


def test_bytes_that_are_no_utf8_count_as_replacements(spark):
    """Every operator over texts survives them; those that decode texts see U+FFFD."""
    from cairn.llm import alignment, exact_dedup, html_text, licences, mixing, near_dedup, packing, quality, token_count, toxicity

    rows = [(1, bytearray(b"a\xff b\xc3")), (2, bytearray("a� b�".encode())), (3, bytearray(b"<p>It is \xf0\x9f bad.</p> " * 20))]
    raw = spark.createDataFrame(rows, "doc_id long, raw binary")
    docs = raw.select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for frame, what in ((token_count.token_counts(docs), "n_tokens"), (packing.pack_documents(docs), "ids"), (quality.judge(docs, quality.fit(docs, labels)), "word_chars"), (toxicity.score(docs, toxicity.fit(docs, labels)), "toxicity"), (html_text.extract(docs, source="text", keep=("doc_id",)), "text")):
        got = {r.doc_id: r[what] for r in frame.collect()}
        assert got[1] == got[2] and set(got) == {1, 2, 3}
    for frame in (near_dedup.near_duplicates(docs), mixing.shares(docs), licences.scan(docs), alignment.align_documents(docs), exact_dedup.exact_groups(docs)):
        assert frame.count() == 3
    assert near_dedup.keep_one(docs).count() and quality.keep_good(docs, labels).count() >= 0 and mixing.mix(docs).count()


def test_names_with_dots(spark):
    from cairn.llm import html_text, licences, packing, quality, token_count, toxicity

    docs = spark.createDataFrame([(1, "some text of words"), (2, None)], "`doc.id` long, `the.text` string")
    for operator in (token_count.token_counts, licences.scan):
        assert operator(docs, text="the.text", keep=("doc.id",)).columns[0] == "doc.id"
    assert html_text.extract(docs, source="the.text", keep=("doc.id",)).count() == 2
    assert packing.pack_documents(docs, key="doc.id", text="the.text").columns[0] == "doc.id"
    labels = spark.createDataFrame([(1, 1, 0)], "`doc.id` long, quality int, toxic int")
    assert quality.keep_good(docs, labels, "doc.id", "the.text").columns == docs.columns == toxicity.keep_civil(docs, labels, key="doc.id", text="the.text").columns
