"""Markdown-table snapshots: lines to rows, header drift, inherited companies, events, observation keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CITIZENS, LOCKED, NO_SPONSOR, Text, col
from ..functions.urls import cell_url, observation_key

INHERIT = "↳"
#: Parser options and their defaults; a file's option overrides its source's.
DEFAULTS = {"company_column": 0, "role_column": 1, "application_column": 3, "min_columns": 5, "inherit_marker": INHERIT}


def cells(line: Text) -> Column:
    """The cells of a table row, split at bars that no backslash escapes."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(col(line)), r"^\|", ""), r"\|$", "")
    # A bar is escaped after an odd number of backslashes.
    return F.transform(F.split(inner, r"\|(?<=(?<!\\)(?:\\\\){0,64}\|)"), lambda c: F.trim(c))


def is_rule(row: Column) -> Column:
    return F.forall(row, lambda c: F.regexp_like(c, F.lit("^:?-{3,}:?$")))


def header_form(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def headers_missed(headers: Column) -> Column:
    """Whether headers are expected, and these are others."""
    forms = lambda c: F.transform(c, header_form)
    return (F.size("expected_headers") > 0) & (forms(F.col("expected_headers")) != forms(headers))


def with_options(snapshots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The snapshots with their parser options: the file's, else the source's, else the default.

    files: source_id, path, and any of the options (also as source_<option>) and expected_headers.
    """
    joined = snapshots if files is None else snapshots.join(F.broadcast(files) if files.isLocal() else files, ["source_id", "path"], "left")
    has = set(joined.columns)
    for name, default in DEFAULTS.items():
        given = [F.col(c) for c in (name, f"source_{name}") if c in has]
        joined = joined.withColumn(name, F.coalesce(*given, F.lit(default)))
    return joined if "expected_headers" in has else joined.withColumn("expected_headers", F.lit(None).cast("array<string>"))


def table_lines(snapshots: DataFrame) -> DataFrame:
    """Every table line that is long enough and no rule: the snapshot's columns, line_no, line, cells."""
    lines = snapshots.select("*", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "__line")).drop("content")
    rows = lines.withColumn("line", F.trim("__line")).drop("__line").filter(F.startswith("line", F.lit("|"))).withColumn("cells", cells("line"))
    return rows.filter((F.size("cells") >= F.col("min_columns")) & ~is_rule(F.col("cells")))


def drift(snapshots: DataFrame) -> DataFrame:
    """source_id, path, captured_at, detail (null: fine; table_headers_missing or table_headers_mismatch) of each snapshot."""
    keys = ["source_id", "path", "captured_at"]
    first = table_lines(snapshots).groupBy(*keys).agg(F.min_by("cells", "line_no").alias("headers"))
    detail = F.when(F.col("headers").isNull(), "table_headers_missing").when(headers_missed(F.col("headers")), "table_headers_mismatch")
    return snapshots.select(*keys, "expected_headers").join(first, keys, "left").select(*keys, "headers", detail.alias("detail"))


def inherited(company_cell: Column, marker: Column, order: list[str], part: list[str]) -> Column:
    """The company of each row: the marker takes the nearest named company above; an empty cell has none and resets nothing."""
    own = F.when((company_cell != marker) & (F.trim(company_cell) != ""), F.trim(F.regexp_replace(company_cell, "[*_`]", "")))
    above = F.last(own, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(company_cell == marker, above).otherwise(own)


def parse_tables(snapshots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """source_id, path, captured_at, row_index, row_text, company, role, application_url of all rows of snapshots without drift.

    snapshots: source_id, path, captured_at, content. A file is one window's work; files are as large as their pages.
    """
    keys = ["source_id", "path", "captured_at"]
    ready = with_options(snapshots, files)
    inside = Window.partitionBy(*keys).orderBy("line_no")
    # The first line tells of drift, as in `drift`, and the lines below it learn of it in the window that numbers them.
    rows = table_lines(ready).filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).withColumn("__n", F.row_number().over(inside))
    rows = rows.withColumn("__missed", F.first(F.when(F.col("__n") == 1, F.coalesce(headers_missed(F.col("cells")), F.lit(False)))).over(inside))
    numbered = rows.filter("__n > 1 AND NOT __missed").withColumn("row_index", (F.col("__n") - 2).cast("long"))
    cell = lambda option: F.coalesce(F.get("cells", F.col(option)), F.lit(""))
    signs = f"{NO_SPONSOR}|{CITIZENS}|{LOCKED}|[*_`]"
    role = F.nullif(F.trim(F.regexp_replace(cell("role_column"), signs, "")), F.lit(""))
    company = inherited(cell("company_column"), F.col("inherit_marker"), ["line_no"], keys)
    return numbered.select(*keys, "row_index", F.col("line").alias("row_text"), company.alias("company"), role.alias("role"), cell_url(cell("application_column")).alias("application_url"))


DEFAULT_PARSER = "markdown_table_v1"
#: Parser id -> function from (snapshots, files) to rows.
PARSERS: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] = {}


def register_parser(name: str, parser: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
    if name in PARSERS:
        raise ValueError(f"a parser of the name {name} is there already")
    PARSERS[name] = parser


def parsers() -> list[str]:
    return sorted(PARSERS)


register_parser("markdown_table_v1", parse_tables)


def parse_files(snapshots: DataFrame, files: DataFrame, known: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] | None = None) -> DataFrame:
    """The rows of all snapshots, each by the parser that its file names (files: source_id, path, parser and options; null or
    no entry: the default), with `parser`. known: parsers by id, else all registered ones. Files that name an unknown parser
    have no rows; see `unknown_parsers`."""
    known = PARSERS if known is None else known
    named = snapshots.join(files.select("source_id", "path", "parser"), ["source_id", "path"], "left").withColumn("parser", F.coalesce("parser", F.lit(DEFAULT_PARSER)))
    options = files.drop("parser")
    made = [known[n](named.filter(F.col("parser") == n).drop("parser"), options).withColumn("parser", F.lit(n)) for n in sorted(known)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def unknown_parsers(files: DataFrame) -> DataFrame:
    """source_id, path, parser of the files that name a parser which isn't registered."""
    return files.filter(F.col("parser").isNotNull() & ~F.col("parser").isin(*parsers())).select("source_id", "path", "parser")


def changed(snapshots: DataFrame, cursors: DataFrame) -> DataFrame:
    """Snapshots whose content differs from what the cursor (source_id, path, content_sha256) saw last."""
    marked = snapshots.withColumn("content_sha256", F.sha2("content", 256))
    return marked.join(cursors.select("source_id", "path", "content_sha256"), ["source_id", "path", "content_sha256"], "left_anti")


def cursors(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """The cursor of each snapshot after its rows are stored: source_id, path, content_sha256, row_count, polled_at (its captured_at)."""
    counted = rows.groupBy("source_id", "path", "captured_at").agg(F.count("*").alias("row_count"))
    marked = snapshots.select("source_id", "path", "captured_at", F.sha2("content", 256).alias("content_sha256"))
    return marked.join(counted, ["source_id", "path", "captured_at"], "left").select("source_id", "path", "content_sha256", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.col("captured_at").alias("polled_at"))


def advance(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored cursors with the fresh ones over them; of several for one file the latest counts."""
    keys, latest = ["source_id", "path"], F.struct("polled_at", "content_sha256")
    newest = fresh.groupBy(*keys).agg(F.max_by(F.struct("content_sha256", "row_count", "polled_at"), latest).alias("c")).select(*keys, "c.*")
    return stored.join(newest.select(*keys), keys, "left_anti").select(*keys, "content_sha256", "row_count", "polled_at").unionByName(newest)


def to_events(rows: DataFrame, repository: Text, branch: Text, commit: Text) -> DataFrame:
    """Raw events of parsed rows; a row is known by its address, else by a hash of where and what it is."""
    digest = F.sha2(F.concat_ws("\n", col(repository), F.col("path"), F.col("row_text")), 256)
    sha = F.when(F.regexp_like(col(commit), F.lit("^[A-Fa-f0-9]{40}$")), F.lower(col(commit)))
    where = F.struct(col(repository).alias("repository"), col(branch).alias("branch"), F.col("path"), sha.alias("commit_sha"), F.col("row_index"))
    return rows.select(
        F.lit(1).alias("schema_version"), F.lit("github").alias("source"), col(repository).alias("source_account"), F.substring(F.coalesce("application_url", digest), 1, 1024).alias("source_event_id"),
        F.concat_ws("/", F.lit("https://github.com"), col(repository), F.lit("blob"), col(branch), F.col("path")).alias("source_url"), "captured_at", F.col("row_text").alias("text"), F.col("company").alias("row_company"), where.alias("metadata"),
    )


def seen_keys(rows: DataFrame, repository: Text) -> DataFrame:
    """Distinct source_id, observation_key of parsed rows."""
    return rows.select("source_id", observation_key(repository, "path", "row_text", "application_url").alias("observation_key")).distinct()
