"""The texts that the operators of this subpackage read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import normal_source_id


def source_states(sources: DataFrame) -> DataFrame:
    """(source_id, sql_text, path, repository, lang): the latest state of every source.

    source_id is in normal form, rows without one are left out. The state is the
    row with the greatest committed_at, a missing one counting as the oldest;
    among rows of the same time the greatest text is taken. Pre-aggregated, so
    one source with most rows is no hot group.
    """
    body = F.struct("sql_text", "path", "repository", "lang")
    order = F.struct(F.coalesce(F.col("committed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("sql_text"))
    return (
        sources.select(normal_source_id("source_id").alias("source_id"), body.alias("b"), order.alias("o"))
        .filter("source_id is not null and source_id <> ''")
        .groupBy("source_id")
        .agg(F.max_by("b", "o").alias("b"))
        .select("source_id", "b.*")
    )


def file_contents(entries: DataFrame) -> DataFrame:
    """(path, content) of every file entry; of differing contents the greatest is taken."""
    return entries.filter("path is not null").groupBy("path").agg(F.max("content").alias("content"))
