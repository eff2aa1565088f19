"""Corpora of T-SQL texts to tokens and objects, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein import schemas
from skein.functions import tsql
from skein.functions.names import fold, normal_source_id


def canonical_sources(sources: DataFrame) -> DataFrame:
    """(source_id, sql_text, path) with source ids in normal form.

    Raises ValueError where an id is empty or where two ids differ in case only.
    """
    out = sources.select(normal_source_id("source_id").alias("source_id"), "sql_text", *(["path"] if "path" in sources.columns else [F.lit(None).cast("string").alias("path")]))
    bad = out.groupBy(fold("source_id").alias("k")).count().filter("k is null or k = '' or count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"empty or duplicate SQL source id: {bad[0]['k']!r}")
    return out


def _objects(batches: Iterator[pa.RecordBatch], source_aware: bool) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(schemas.OBJECTS)
    for batch in batches:
        rows = []
        for source_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, row in enumerate(tsql.parse(text, source_id if source_aware else None)):
                rows.append({"source_id": source_id, "object_ord": i, **row})
        if rows:
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


def parse_sources(sources: DataFrame, source_aware: bool = True) -> DataFrame:
    """One row for each object of each source (schemas.OBJECTS), in a narrow pass over the texts.

    Null or blank text has no object; other columns are ignored. Without
    source_aware, fallback scripts keep the name UnnamedScript.
    """
    rows = sources.select("source_id", "sql_text")
    return rows.mapInArrow(lambda it: _objects(it, source_aware), schemas.OBJECTS)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(schemas.TOKENS)

    def out(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        cols: list[list] = [[] for _ in schemas.TOKENS.fields]
        for source_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text or not text.strip():
                continue
            stmt, go = 0, 0
            for i, t in enumerate(tsql.tokenize(text)):
                if t.word == "GO" and tsql._alone(text, t.position):
                    stmt, go = stmt + 1, go + 1
                    continue
                for c, v in zip(cols, (source_id, i, stmt, go, t.kind, t.value, t.position), strict=True):
                    c.append(v)
                if t.value == ";":
                    stmt += 1
            if len(cols[0]) > 100_000:
                yield out(cols)
                cols = [[] for _ in schemas.TOKENS.fields]
        yield out(cols)


def tokens(sources: DataFrame) -> DataFrame:
    """One row for each token (schemas.TOKENS); batch separators give none."""
    return sources.select("source_id", "sql_text").mapInArrow(_tokens, schemas.TOKENS)


# Patterns by which a file is classed, and those counted by the lint pass.
CLASS_PATTERNS = [("Stored Procedure", r"\bCREATE\s+(OR\s+ALTER\s+)?PROCEDURE\b"), ("View", r"\bCREATE\s+VIEW\b"), ("Function", r"\bCREATE\s+FUNCTION\b")]
LINT_PATTERNS = [("SELECT_STAR", r"SELECT\s+\*"), ("NOCOUNT", r"SET\s+NOCOUNT\s+ON"), ("CURSOR", r"\bCURSOR\b"), ("TEMP_TABLE", r"#\w+"), ("DYNAMIC_SQL", r"sp_executesql|EXEC\s*\(")]


def file_kind(text: Column, patterns: list[tuple[str, str]] = CLASS_PATTERNS) -> Column:
    """The kind of a file: that of the first pattern found in it, else Script; null counts as empty."""
    out = F.lit("Script")
    for kind, pattern in reversed(patterns):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?iU){pattern}"), kind).otherwise(out)
    return out


def kind_summary(kinds: DataFrame) -> DataFrame:
    """One row: files in all and by kind."""
    names = {"stored_procedures": "Stored Procedure", "views": "View", "functions": "Function", "scripts": "Script"}
    return kinds.agg(F.count(F.lit(1)).alias("total_sql_files"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in names.items()])


def lint_counts(sources: DataFrame) -> DataFrame:
    """(source_id, rule, matches): matches of every lint pattern, zeros kept, in one pass over the text."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count(F.coalesce("sql_text", F.lit("")), F.lit(f"(?iU){p}")).alias("matches")) for n, p in LINT_PATTERNS])
    return sources.select("source_id", F.explode(counts).alias("c")).select("source_id", "c.rule", "c.matches")
