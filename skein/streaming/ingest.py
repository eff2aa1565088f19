"""Sources that keep arriving: parsed as they come, the graph kept up to date by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein import schemas
from skein.plans.graph import Graph, build_graph
from skein.plans.parse import parse_sources


def source_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (source_id, sql_text, path) from parquet files that land in a folder."""
    return spark.readStream.schema(schemas.SOURCES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def object_stream(sources: DataFrame) -> DataFrame:
    """The objects of each arriving source; parsing is local to a source, so rows are only appended."""
    return parse_sources(sources)


def keep_graph(sources: DataFrame, objects_path: str, on_graph: Callable[[Graph, int], None], checkpoint: str) -> StreamingQuery:
    """Append each batch's objects to a table and hand the graph of all objects so far to ``on_graph``.

    A batch that is run again after a failure overwrites what it wrote before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parse_sources(batch).write.mode("overwrite").parquet(f"{objects_path}/batch={number}")
        stored = spark.read.schema(schemas.OBJECTS).parquet(objects_path)
        on_graph(build_graph(stored), number)

    return sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
