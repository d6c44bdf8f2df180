"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of SIZE bytes. The distinct blocks are sorted, and a block's place is its integer
name; the distinct pairs of neighbouring names are sorted and named in turn, until one name is left of each text. A text
of n blocks is done after ceil(log2(n)) such rounds, and two texts have the same name of the same round exactly if they
are equal: what is named are contents, never hashes.

Texts travel once, as blocks, copies merged in their tasks before. Rows look their blocks' names up by a 128-bit key of
two hashes; the pass over the contents proves that no two blocks share a key (else it is repeated with other seeds).
A block, pair or text that fills a large part of the table is looked up in a broadcast of such names, which are few.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import sealed
from .shared import by_share, cut_lineage, quoted, read

#: Bytes of a block.
SIZE = 4096


def normalised(text: Column) -> Column:
    """The text's bytes with A-Z in lower case; null as empty. Bytes are read as Latin-1, a character each, so what isn't
    UTF-8 keeps its differences; where all bytes are ASCII, `lower` does the same faster."""
    known = F.coalesce(text, F.lit(""))
    ascii_only = F.is_valid_utf8(known) & (F.octet_length(known) == F.char_length(known))
    bytewise = F.encode(F.translate(F.decode(known.cast("binary"), "ISO-8859-1"), string.ascii_uppercase, string.ascii_lowercase), "ISO-8859-1")
    return F.when(ascii_only, F.lower(known).cast("binary")).otherwise(bytewise)


def block_at(i: Column, size: int) -> Column:
    return F.substring("bytes", (i * size + 1).cast("int"), F.lit(size))


def block_numbers(size: int) -> Column:
    """0 to the number of the text's last block; an empty text is one empty block."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("bytes") / size).cast("int") - 1))


def key_of(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block).alias("b"))


def sorted_names(distinct: DataFrame, key: str) -> DataFrame:
    """The rows with `name`: integers that rise with the key over the whole cluster's sort."""
    return cut_lineage(distinct.orderBy(key).withColumn("name", F.monotonically_increasing_id()))


def named_rows(rows: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """rows with the names of their keys instead of these. counted: each key and n, its number of rows."""
    return by_share(rows, sorted_names(counted, key), key, "n").drop(key)


def marked(docs: DataFrame, key: str, text: str, size: int, seed: int) -> DataFrame:
    """row (a number of its own), id, sha and the keys of the row's blocks, for each row."""
    source = docs.select(F.col(quoted(key)).alias("id"), normalised(F.col(quoted(text))).alias("bytes")).withColumn("row", F.monotonically_increasing_id())
    keys = F.transform(block_numbers(size), lambda i: key_of(block_at(i, size), seed))
    return cut_lineage(sealed(source, "bytes").select("row", "id", F.sha2("bytes", 256).alias("sha"), keys.alias("keys")))


def shared_keys(docs: DataFrame, text: str, size: int, seed: int) -> bool:
    """Whether two different blocks have one key: all distinct blocks, with their contents, are held against each other."""
    source = sealed(docs.select(normalised(F.col(quoted(text))).alias("bytes")), "bytes")
    block = source.select("bytes", F.explode(block_numbers(size)).alias("i")).select(block_at(F.col("i"), size).alias("block"))
    contents = block.select(key_of(F.col("block"), seed).alias("key"), "block").distinct().select("key")
    return not contents.groupBy("key").count().filter("count > 1").isEmpty()


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """row, id, sha and name (struct of round and integer) for each row; equal texts have equal names, others never."""
    for seed in itertools.count(42):
        rows = marked(docs, key, text, size, seed)
        if not shared_keys(docs, text, size, seed):
            break
    own = rows.select("row", F.posexplode("keys").alias("at", "key"), F.size("keys").alias("left"))
    placed = cut_lineage(named_rows(own, "key", own.groupBy("key").agg(F.count("*").alias("n"))))
    done = []
    for turn in itertools.count():
        done.append(placed.filter("left = 1").select("row", F.struct(F.lit(turn).alias("turn"), F.col("name").alias("n")).alias("name")))
        rest = placed.filter("left > 1")
        if rest.isEmpty():
            break
        # -1 is no name, so a last name without a neighbour is a pair of its own.
        side = lambda odd: F.coalesce(F.max(F.when(F.col("at") % 2 == odd, F.col("name"))), F.lit(-1)).alias("ab"[odd])
        pairs = rest.groupBy("row", F.expr("at div 2").alias("at")).agg(side(0), side(1), F.expr("(any_value(left) + 1) div 2").alias("left"))
        pairs = cut_lineage(pairs.select("row", "at", F.struct("a", "b").alias("key"), "left"))
        placed = cut_lineage(named_rows(pairs, "key", pairs.groupBy("key").agg(F.count("*").alias("n"))))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return cut_lineage(rows.drop("keys").join(every, "row"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 for every row of `docs`.

    Texts are equal when identical after A-Z are lower-cased; a null text counts as empty. The row of the largest key
    stays; of several such rows one. A null key is smaller than any other; a group without any key has a null keep_id
    and one row of it stays. Bytes that aren't UTF-8 are compared as they are. An empty table gives an empty result.
    Other columns are ignored.
    """
    named = identities(docs, key, text, size)
    best = F.max(F.struct("id", "row")).alias("best")
    facts = named.groupBy("name").agg(best, F.count("*").alias("group_size"), F.count("*").alias("n"))
    joined = by_share(named, facts, "name", "n")
    return joined.select(F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS normal FROM documents),
groups AS (SELECT normal, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM texts JOIN groups USING (normal)
"""
