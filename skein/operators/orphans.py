"""References to records that do not exist (or did not at the time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import name_key
from skein.operators.chunked import number_rows
from skein.runtime import materialize

BITS = 32768  # of one bitmap, as bitmap_construct_agg makes it
PROBES = 4
MAX_BITMAPS = 2048  # 8 MB: the most that is ever broadcast; larger filters are joined by bucket
SALT = 16  # copies of a bitmap where a larger filter is joined, so that a hot key is spread


def _probes(key: str):
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(BITS)) for i in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``key`` as a table (bucket, bits), and its bucket count.

    Every key sets PROBES bits in one bitmap of 32,768. There are as many
    bitmaps as the keys need, so the share of false positives is the same for
    any number of keys.
    """
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    buckets = max(1, -(-n * bits_per_key // BITS))
    bits = keys.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.explode(F.array(*_probes(key))).alias("bit")
    )
    return bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), buckets


def probe(refs: DataFrame, key: str, bloom: DataFrame, buckets: int, max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """``refs`` plus ``may_exist``: false proves that the key is in no record.

    A filter of at most ``max_bitmaps`` bitmaps of 4 KB is broadcast. A larger
    one meets the rows by bucket instead, each bitmap in SALT copies so that a
    hot key fills no task. Columns of ``refs`` named bucket, bits or salt are
    left out.
    """
    hit = F.lit(True)
    for p in _probes(key):
        # The byte of a bit, as a number: one character of the bitmap read as Latin-1.
        byte = F.ascii(F.decode(F.substring(F.col("bits"), (F.floor(p / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        hit = hit & (F.call_function("getbit", byte, (p % 8).cast("int")) == 1)
    refs = refs.drop("bucket", "bits", "salt")
    by = ["bucket"]
    rows = refs.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    if buckets <= max_bitmaps:
        bloom = F.broadcast(bloom)
    else:
        by = ["bucket", "salt"]
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in refs.columns]), F.lit(SALT)))
        bloom = bloom.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return rows.join(bloom, by, "left").withColumn("may_exist", F.col("bits").isNotNull() & F.coalesce(hit, F.lit(False))).drop("bits", *by)


def references(edges: DataFrame, nodes: DataFrame, system: DataFrame) -> DataFrame:
    """All references (table_name, record_id, name_key, at) that can be orphans.

    Null or blank names, names of the database server, nodes of unknown type
    and references without a time are none.
    """
    e = edges.select(
        F.lit("dependency_edge").alias("table_name"), F.col("edge_id").alias("record_id"), name_key("target").alias("name_key"), F.col("seen_at").alias("at")
    )
    known = F.lower(F.btrim("object_type", F.lit(" \t")))
    n = nodes.filter(known.isNotNull() & ~known.isin("", "unknown")).select(
        F.lit("dependency_node").alias("table_name"), F.col("node_id").alias("record_id"), name_key("name").alias("name_key"), F.col("registered_at").alias("at")
    )
    refs = e.unionByName(n).filter("name_key is not null and at is not null and record_id is not null")
    fixed = system.select(name_key("name").alias("name_key")).filter("name_key is not null").distinct()
    return refs.join(F.broadcast(fixed), "name_key", "left_anti")  # a fixed table of some dozen rows


def lifetimes(records: DataFrame) -> DataFrame:
    """(name_key, defined_at, removed_at) of each record's latest delivery."""
    latest = records.groupBy("object_id").agg(
        F.max_by(F.struct("name", "defined_at", "removed_at"), F.col("ingested_at")).alias("r")
    )
    return latest.select(name_key("r.name").alias("name_key"), "r.defined_at", "r.removed_at").filter(
        "name_key is not null and defined_at is not null and (removed_at is null or removed_at > defined_at)"
    )


def find_orphans(edges: DataFrame, nodes: DataFrame, records: DataFrame, system: DataFrame) -> DataFrame:
    """References that name no record living at that time.

    Columns table_name, record_id, name_key, at, filter_proved. A record lives
    from defined_at (included) to removed_at (excluded); repeated rows of a
    reference give one row. The Bloom filter proves most orphans; the others are
    joined exactly: definitions, removals and references are merged in (name,
    time) order and the running number of living records is read off, so
    neither a hot name nor a name with many records holds up one task. Rows are
    compared by time alone, hence late deliveries change nothing. Empty tables
    give empty results (no records: every reference is an orphan).
    """
    refs = references(edges, nodes, system)
    lives = materialize(lifetimes(records), "lifetimes")
    bloom, buckets = bloom_filter(lives, "name_key")
    probed = materialize(probe(refs, "name_key", bloom, buckets), "probed")
    absent = probed.filter("not may_exist").select("table_name", "record_id", "name_key", "at")

    moves = lives.select("name_key", F.col("defined_at").alias("at"), F.lit(1).alias("change")).unionByName(
        lives.filter("removed_at is not null").select("name_key", F.col("removed_at").alias("at"), F.lit(-1).alias("change"))
    )
    moves = moves.groupBy("name_key", "at").agg(F.sum("change").alias("change"), F.sum(F.abs("change")).alias("moves"))
    moves = moves.select("name_key", "at", "change", "moves", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("record_id"), F.lit(0).alias("is_ref"))
    asked = probed.filter("may_exist").select("name_key", "at", F.lit(0).cast("long").alias("change"), F.lit(0).cast("long").alias("moves"), "table_name", "record_id", F.lit(1).alias("is_ref"))
    merged = number_rows(moves.unionByName(asked), "name_key", ["at", "is_ref"], sums=["change"], label="lives")
    dead = merged.filter("is_ref = 1 and _run_change <= 0").select("table_name", "record_id", "name_key", "at")
    return (
        absent.withColumn("filter_proved", F.lit(True))
        .unionByName(dead.withColumn("filter_proved", F.lit(False)))
        .dropDuplicates(["table_name", "record_id"])
    )


def orphan_rates(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans and references by referring table and month."""
    month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    found = orphans.groupBy("table_name", month).agg(F.count(F.lit(1)).alias("orphans"))
    total = refs.dropDuplicates(["table_name", "record_id"]).groupBy("table_name", month).agg(F.count(F.lit(1)).alias("refs"))
    return total.join(found, ["table_name", "month"], "left").select(
        "table_name", "month", "refs", F.coalesce("orphans", F.lit(0)).alias("orphans")
    )
