"""Source files that do not parse as the language they claim to be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import normal_source_id

# What a file name's ending declares.
EXTENSIONS = {"sql": "tsql", "json": "json", "xml": "xml", "sqlproj": "xml", "py": "python"}


def _language(lang: str | None, path: str | None, source_id: str) -> str | None:
    from skein.llm.grammars import LEXERS

    named = (lang or "").strip().lower()
    if named in LEXERS:
        return named
    return EXTENSIONS.get((path or source_id).rstrip().rpartition(".")[2].lower())


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from skein.llm.grammars import examine

    for batch in batches:
        ids, texts, langs, paths, repos = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for source_id, text, lang, path in zip(ids, texts, langs, paths, strict=True):
            language = _language(lang, path, source_id)
            verdict, at = ("sound", None) if language is None else examine(text, language)
            out.append((language, verdict, at))
        language, verdict, at = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(4), pa.array(language, type=pa.string()), pa.array(verdict, type=pa.string()), pa.array(at, type=pa.int64()), batch.column(5)],
            names=["source_id", "repository", "lang", "verdict", "at", "time"],
        )


def examine_sources(sources: DataFrame, latest: str | None = None) -> DataFrame:
    """(source_id, repository, lang, verdict, at) of every source.

    verdict is ``sound``, ``fails`` (at: code-point offset of the token with the
    empty derivative) or ``ends early`` (the text stops where its language
    cannot). Null, empty and comment-only texts are sound, and so is text in a
    language for which there is no grammar. The language is that of ``lang``,
    else that of the file name's ending.

    With ``latest``, a column of times, source ids are read in normal form and
    only the row with the greatest time counts for each (a missing time is the
    least; of rows of one time, one that is unsound). Texts are examined where
    they lie; only verdicts are shuffled.
    """
    time = F.col(latest).cast("timestamp") if latest else F.lit(None).cast("timestamp")
    rows = sources.select(normal_source_id("source_id").alias("source_id") if latest else F.col("source_id"), "sql_text", "lang", "path", "repository", time.alias("time"))
    if latest:
        rows = rows.filter("source_id is not null and source_id <> ''")
    out = rows.mapInArrow(_examine, "source_id string, repository string, lang string, verdict string, at long, time timestamp")
    if latest:
        order = F.struct(F.coalesce("time", F.lit("0001-01-01").cast("timestamp")), F.col("verdict") != "sound", F.coalesce("at", F.lit(-1)))
        out = out.groupBy("source_id").agg(F.max_by(F.struct("repository", "lang", "verdict", "at"), order).alias("r")).select("source_id", "r.*")
    return out.select("source_id", "repository", "lang", "verdict", "at")


def rates(examined: DataFrame) -> DataFrame:
    """Sources and unsound sources by repository and language; a null repository is its own group."""
    return (
        examined.groupBy("repository", "lang")
        .agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("verdict") != "sound").alias("unsound"))
        .withColumn("rate", F.col("unsound") / F.col("sources"))
    )


def with_hints(faults: DataFrame, runs: DataFrame) -> DataFrame:
    """``faults`` plus ``hinted``: whether any parser run reported something for the source."""
    said = (
        runs.select(normal_source_id("source_id").alias("source_id"), (F.size("diagnostics") > 0).alias("said"))
        .groupBy("source_id")
        .agg(F.max("said").alias("said"))
    )
    return faults.join(said, "source_id", "left").withColumn("hinted", F.coalesce("said", F.lit(False))).drop("said")
