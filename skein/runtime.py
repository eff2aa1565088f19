"""Session helpers: the shared folder, cut lineage, small driver-side values.

Intermediate results that several later jobs read are written as parquet below
``spark.checkpoint.dir``, the folder every executor sees. A lost executor then
costs only the tasks it was running. Only a purely local master, as in tests,
may fall back to a folder of this machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folder: str | None = None
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; raises on a cluster that names none."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="skein-")
    return f"file://{_local_folder}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    Cuts lineage and fixes rows that a recomputation might place elsewhere.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._skein_path = path  # type: ignore[attr-defined]
    return back


def materialize_counting(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows as they were written, in one job."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    return out, seen.get


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize`; other frames are left alone."""
    path = getattr(df, "_skein_path", None)
    if path is not None and path in _written:
        _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; nothing more can be done then
        pass


def _clean() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)


atexit.register(_clean)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan in at least as many partitions as there are cores.

    For work in Python on tables of a few files; a scan that has enough
    partitions is left as it is, so large inputs are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named parquet tables of a data folder, one frame or a tuple."""
    frames = tuple(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names)
    return frames[0] if len(frames) == 1 else frames
