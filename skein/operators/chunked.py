"""Exact offset chunking: ordered per-key work that no hot key can hold up.

Rows are range-partitioned by (key, order), so a key that holds a third of all
rows is spread over a third of the partitions. Every partition numbers and sums
its own rows; the states at partition borders, at most one open key for each
partition, are prefix-merged and added. Positions are exact, hence every key
can be cut into chunks of equal size, and chunk states merge in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from skein.runtime import materialize


def _number(batches: Iterator[pa.RecordBatch], key: str, sums: Sequence[str], previous: Sequence[str], names: list[str]):
    """Positions, running sums and previous values of a sorted partition, batch by batch.

    At the end come the states of its first and last key, the only ones that
    other partitions can share: rows with ``_state`` that hold the key, and
    counts, sums and last values in place of positions, sums and previous ones.
    """
    pid = TaskContext.get().partitionId()
    open_key = None
    count = 0
    totals = dict.fromkeys(sums, 0)
    before: dict[str, pa.Scalar] = {}
    first: dict = {"open": True, "rows": 0, "sums": dict.fromkeys(sums, 0), "last": {}}
    schema = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        keys = batch.column(names.index(key))
        fresh = np.ones(n, dtype=bool)
        if n > 1:
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = open_key is None or keys[0].as_py() != open_key
        starts = np.flatnonzero(fresh)
        others = starts[1:] if open_key is None else starts  # where keys other than the partition's first begin
        lead = 0
        if first["open"]:
            lead = int(others[0]) if len(others) else n
            first["rows"] += lead
            first["open"] = not len(others)
            first.setdefault("key", keys[0].as_py())
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        position = np.arange(n) - np.maximum(at, 0) + np.where(at < 0, count, 0)
        added = [pa.array(np.full(n, pid, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), pa.array(position.astype(np.int64))]
        for s in sums:
            values = batch.column(names.index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(values)
            first["sums"][s] += int(run[lead - 1]) if lead else 0
            base = np.where(at < 0, -totals[s], np.where(at > 0, run[np.maximum(at, 1) - 1], 0))
            run = run - base
            totals[s] = int(run[-1])
            added.append(pa.array(run))
        for p in previous:
            values = batch.column(names.index(p))
            one = pa.array([None if fresh[0] else before[p].as_py()], type=values.type)
            shifted = pa.concat_arrays([one, values.slice(0, n - 1)])
            if len(starts):
                shifted = pc.if_else(pa.array(fresh), pa.scalar(None, type=values.type), shifted)
            added.append(shifted)
            before[p] = values[n - 1]
            if lead:
                first["last"][p] = values[lead - 1]
        open_key = keys[n - 1].as_py()
        count = int(position[-1]) + 1
        out = pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "_pid", "_state", "_pos", *(f"_run_{s}" for s in sums), *(f"_prev_{p}" for p in previous)])
        schema = out.schema
        yield out
    if schema is None:
        return
    states = [(first["key"], first["rows"], first["sums"], first["last"])]
    if not first["open"]:
        states.append((open_key, count, totals, before))
    for k, n, total, last in states:
        row = dict.fromkeys(schema.names) | {key: k, "_pid": pid, "_state": True, "_pos": n} | {f"_run_{s}": v for s, v in total.items()} | {f"_prev_{p}": v.as_py() for p, v in last.items()}
        yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in schema], schema=schema)


def number_rows(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    sums: Sequence[str] = (),
    previous: Sequence[str] = (),
    partitions: int | None = None,
    label: str = "numbered",
) -> DataFrame:
    """``df`` plus ``_pos``, ``_run_<sum>`` and ``_prev_<column>`` in each key's order.

    ``_pos`` counts from 0; ``_run_x`` is the sum of ``x`` up to and including the
    row; ``_prev_x`` is ``x`` of the row before, null on a key's first row. Rows
    whose key is null are dropped, null sums count as 0. Rows equal in key and
    order are placed side by side in an order that is fixed once written.
    An empty input gives an empty result. Columns of the input that are named
    like an added or internal one (leading underscore) are left out.
    """
    taken = {"_pid", "_state", "_pos", "_tie", "_n", "_last", "_o", "_before", *(f"{p}{s}" for s in sums for p in ("_run_", "_s_", "_o_")), *(f"_prev_{p}" for p in previous)}
    df = df.select(*[c for c in df.columns if c.lower() not in taken or c in (key, *order_by, *sums, *previous)])
    cols = df.columns
    df = df.filter(F.col(key).isNotNull()).withColumns({s: F.coalesce(F.col(s).cast("long"), F.lit(0)) for s in sums})
    # Repeated rows tie in every column; the last sort key spreads even those.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by: list[Column] = [F.col(c) for c in [key, *order_by, "_tie"]]
    ranged = tied.repartitionByRange(partitions, *by) if partitions else tied.repartitionByRange(*by)
    ranged = ranged.sortWithinPartitions(*by).drop("_tie")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ranged.schema.fields])
    for name, kind in [("_pid", T.IntegerType()), ("_state", T.BooleanType()), ("_pos", T.LongType()), *((f"_run_{s}", T.LongType()) for s in sums)]:
        schema = schema.add(name, kind)
    for p in previous:
        schema = schema.add(f"_prev_{p}", df.schema[p].dataType)
    written = materialize(ranged.mapInArrow(lambda it: _number(it, key, sums, previous, cols), schema), label)
    local = written.filter("not _state")

    # What partitions hand on: rows, sums and last values of their first and last keys, two rows for each.
    last = F.struct(*[F.col(f"_prev_{p}").alias(p) for p in previous]) if previous else F.lit(None)
    states = written.filter("_state").select("_pid", key, F.col("_pos").alias("_n"), *[F.col(f"_run_{s}").alias(f"_s_{s}") for s in sums], last.alias("_last"))
    w = Window.partitionBy(key).orderBy("_pid")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        states.withColumns(
            {"_o": F.sum("_n").over(earlier), **{f"_o_{s}": F.sum(f"_s_{s}").over(earlier) for s in sums}, "_before": F.lag("_last").over(w)}
        )
        .filter(F.col("_o").isNotNull())
        .select(F.col("_pid"), F.col(key), "_o", *[f"_o_{s}" for s in sums], "_before")
    )
    # A partition continues at most one key of an earlier one: no more rows than partitions.
    out = local.join(F.broadcast(offsets), ["_pid", key], "left")
    result = {"_pos": F.col("_pos") + F.coalesce("_o", F.lit(0))}
    result |= {f"_run_{s}": F.col(f"_run_{s}") + F.coalesce(f"_o_{s}", F.lit(0)) for s in sums}
    result |= {
        f"_prev_{p}": F.when((F.col("_pos") == 0) & F.col("_o").isNotNull(), F.col(f"_before.{p}")).otherwise(F.col(f"_prev_{p}"))
        for p in previous
    }
    added = ["_pos", *(f"_run_{s}" for s in sums), *(f"_prev_{p}" for p in previous)]
    return out.select(*cols, *[result[c].alias(c) for c in added])


def chunk_states(numbered: DataFrame, key: str, states: dict[str, Column], chunk_rows: int) -> DataFrame:
    """One row for each chunk of ``chunk_rows`` consecutive rows of a key."""
    chunk = F.floor(F.col("_pos") / F.lit(chunk_rows)).alias("chunk")
    return numbered.groupBy(F.col(key), chunk).agg(*[c.alias(n) for n, c in states.items()])


def edge_target_stats(edges: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Per target name key: rows, executes rows, first and last sighting, longest silence.

    Null and blank targets are left out; rows without seen_at count but have no
    part in the times. Columns: name_key, n_rows, n_executes, first_seen,
    last_seen, longest_gap_s (0 where a name was seen once).
    """
    from skein.functions.names import name_key

    rows = edges.select(
        name_key("target").alias("name_key"),
        F.col("seen_at"),
        F.col("edge_id"),
        (F.lower(F.trim("kind")) == "executes").cast("int").alias("is_exec"),
    ).filter("name_key is not null")
    numbered = number_rows(rows, "name_key", ["seen_at", "edge_id"], previous=["seen_at"], label="edge-targets")
    gap = F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("_prev_seen_at").cast("timestamp"))
    chunks = chunk_states(
        numbered,
        "name_key",
        {
            "rows": F.count(F.lit(1)),
            "executes": F.sum(F.coalesce("is_exec", F.lit(0))),
            "first": F.min("seen_at"),
            "last": F.max("seen_at"),
            "gap": F.max(gap),
        },
        chunk_rows,
    )
    return chunks.groupBy("name_key").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("executes").alias("n_executes"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.coalesce(F.max("gap") / 1e6, F.lit(0.0)).alias("longest_gap_s"),
    )


def dependent_entries(records: DataFrame) -> DataFrame:
    """(name_key, entry): the dependents in the latest delivery of each object_id."""
    from skein.functions.names import name_key

    latest = records.groupBy("object_id").agg(
        F.max_by(F.struct("name", "dependents"), F.col("ingested_at")).alias("r")
    )
    return latest.select(name_key("r.name").alias("name_key"), F.explode("r.dependents").alias("entry"))


def dependent_stats(records: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Per record name key: entries of dependents and different dependents.

    The latest delivery of each object_id counts. Null or empty lists give no
    entry; a null entry counts as an entry but as no dependent. Columns:
    name_key, n_entries, n_dependents.
    """
    from skein.functions.names import name_key

    entries = dependent_entries(records).select("name_key", name_key("entry").alias("dependent"))
    numbered = number_rows(entries, "name_key", ["dependent"], previous=["dependent"], label="dependents")
    is_new = F.col("dependent").isNotNull() & ~F.col("dependent").eqNullSafe(F.col("_prev_dependent"))
    chunks = chunk_states(
        numbered, "name_key", {"rows": F.count(F.lit(1)), "fresh": F.sum(is_new.cast("long"))}, chunk_rows
    )
    return chunks.groupBy("name_key").agg(F.sum("rows").alias("n_entries"), F.sum("fresh").alias("n_dependents"))


def key_offsets(rows: DataFrame, key: str) -> DataFrame:
    """(key, part, n, before): how many rows of a key each input partition holds, and how many lie in earlier ones.

    Counted inside the partitions, so what is shuffled is one row for each key
    of a partition; a hot key gives no more rows than there are partitions.
    Null keys are dropped.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key, F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def count_chunks(offsets: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """(key, chunk, rows): how many rows each chunk of ``chunk_rows`` consecutive rows of a key holds, from its offsets.

    The rows that a partition holds of a key are numbered from ``before`` on; a
    count needs the ends of that run only, so the rows themselves stay where
    they are.
    """
    first, last = F.floor(F.col("before") / chunk_rows), F.floor((F.col("before") + F.col("n") - 1) / chunk_rows)
    runs = offsets.select(key, "before", (F.col("before") + F.col("n")).alias("end"), F.explode(F.sequence(first, last)).alias("chunk"))
    inside = F.least("end", (F.col("chunk") + 1) * chunk_rows) - F.greatest("before", F.col("chunk") * chunk_rows)
    return runs.groupBy(key, "chunk").agg(F.sum(inside).alias("rows"))


def key_totals(rows: DataFrame, key: str, chunk_rows: int = 100_000) -> DataFrame:
    """(key, n_rows): the rows of every key, merged from its chunks."""
    return count_chunks(key_offsets(rows, key), key, chunk_rows).groupBy(key).agg(F.sum("rows").alias("n_rows"))


def heavy_keys(stats: DataFrame, count: str, share: float) -> DataFrame:
    """The keys of ``stats`` that hold at least ``share`` of the sum of ``count``."""
    stats = materialize(stats, "per-key")
    total = stats.agg(F.sum(count)).first()[0] or 0  # one number
    return stats.filter(F.col(count) >= F.lit(share * total))
