"""Queries of the core problems: orphan references, hot keys, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.names import name_key
from skein.operators import chunked, hierarchy, orphans
from skein.runtime import load, materialize

HEAVY = 0.015  # the share of rows from which p5_found lists a name

EDGE = "dependency_edge"
NODE = "dependency_node"
RECORD = "repository_object_record"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references, one row for each edge or node."""
    return _orphans(spark, d).select("table_name", "record_id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes, records, system = load(spark, d, EDGE, NODE, RECORD, "system_object")
    return orphans.find_orphans(edges, nodes, records, system)


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and references by referring table and month."""
    edges, nodes, system = load(spark, d, EDGE, NODE, "system_object")
    return orphans.orphan_rates(_orphans(spark, d), orphans.references(edges, nodes, system))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Names holding at least 1.5 percent of the edges' targets or of the records' dependents."""
    edges, records = load(spark, d, EDGE, RECORD)
    by_target = chunked.heavy_keys(chunked.key_totals(edges.select(name_key("target").alias("name_key")), "name_key"), "n_rows", HEAVY)
    by_name = chunked.heavy_keys(chunked.key_totals(chunked.dependent_entries(records), "name_key"), "n_rows", HEAVY)
    return by_target.select(F.lit(EDGE).alias("table_name"), "name_key").unionByName(
        by_name.select(F.lit(RECORD).alias("table_name"), "name_key")
    )


def p5_edge_targets(spark: SparkSession, d: str) -> DataFrame:
    return chunked.edge_target_stats(load(spark, d, EDGE)).drop("first_seen", "last_seen").withColumn(
        "longest_gap_s", F.round("longest_gap_s", 3)
    )


def p5_dependents(spark: SparkSession, d: str) -> DataFrame:
    return chunked.dependent_stats(load(spark, d, RECORD))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and loop membership of every name in an executes row."""
    return hierarchy.resolve_hierarchy(hierarchy.executes_links(load(spark, d, EDGE)))


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links, their roots and paths."""
    links = materialize(hierarchy.executes_links(load(spark, d, EDGE)), "links")
    roots = hierarchy.resolve_hierarchy(links)
    return links, roots, hierarchy.paths(links, roots)


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d)[2].select("node_key", F.array_join("path", " > ").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    links, roots, found = _paths(spark, d)
    return hierarchy.descendants(found, hierarchy.loop_pairs(links, roots))


QUERIES = {
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p5_found": p5_found,
    "p5_edge_targets": p5_edge_targets,
    "p5_dependents": p5_dependents,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
}

_KEY = "lower(trim({0}, ' ' || chr(9)))"
_LIVES = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ingested_at DESC) AS rn FROM repository_object_record) WHERE rn = 1),
lives AS (SELECT {_KEY.format("name")} AS k, defined_at AS f, coalesce(removed_at, TIMESTAMP '9999-01-01') AS t FROM latest WHERE defined_at IS NOT NULL),
sysn AS (SELECT {_KEY.format("name")} AS k FROM system_object),
refs AS (SELECT DISTINCT * FROM (
  SELECT 'dependency_edge' AS table_name, edge_id AS record_id, {_KEY.format("target")} AS k, seen_at AS ts FROM dependency_edge
  UNION ALL
  SELECT 'dependency_node', node_id, {_KEY.format("name")}, registered_at FROM dependency_node
  WHERE coalesce({_KEY.format("object_type")}, '') NOT IN ('', 'unknown'))
  WHERE k <> '' AND ts IS NOT NULL AND k NOT IN (SELECT k FROM sysn)),
orphan AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.k = r.k AND l.f <= r.ts AND r.ts < l.t))"""
_TARGETS = f"""tg AS (SELECT {_KEY.format("target")} AS name_key, * EXCLUDE (name) FROM (SELECT *, 0 AS name FROM dependency_edge))"""
_ENTRIES = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ingested_at DESC) AS rn FROM repository_object_record) WHERE rn = 1),
en AS (SELECT {_KEY.format("name")} AS name_key, unnest(dependents) AS entry FROM latest)"""
TREE = f"""raw AS (SELECT nullif({_KEY.format("target")}, '') AS c, nullif({_KEY.format("source")}, '') AS p FROM dependency_edge WHERE lower(trim(kind)) = 'executes'),
l AS (SELECT c, min(p) AS p FROM raw WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY c),
nodes AS (SELECT c AS n FROM raw WHERE c IS NOT NULL UNION SELECT p FROM raw WHERE p IS NOT NULL),
walk(n, a, s) AS (SELECT c, p, 1 FROM l UNION SELECT w.n, l.p, w.s + 1 FROM walk w JOIN l ON l.c = w.a WHERE w.n <> w.a AND w.s < 400),
loops AS (SELECT n, min(s) AS len FROM walk WHERE n = a GROUP BY n),
loopkey AS (SELECT w.n, least(min(w.a), w.n) AS k FROM walk w JOIN loops o ON o.n = w.n AND w.s <= o.len GROUP BY w.n),
ans AS (SELECT n, k AS r, 0 AS d, 1 AS cyc FROM loopkey
  UNION ALL SELECT w.n, min_by(k.k, w.s), min(w.s), 0 FROM walk w JOIN loopkey k ON k.n = w.a WHERE w.n NOT IN (SELECT n FROM loopkey) GROUP BY w.n
  UNION ALL SELECT w.n, w.a, w.s, 0 FROM walk w WHERE w.a NOT IN (SELECT c FROM l)
  UNION ALL SELECT n, n, 0, 0 FROM nodes WHERE n NOT IN (SELECT c FROM l))"""

ORACLES = {
    "p3_found": f"WITH {_LIVES} SELECT table_name, record_id FROM orphan",
    "p3_rates": f"""WITH {_LIVES} SELECT r.table_name, strftime(r.ts, '%Y-%m') AS month, count(*) AS refs, count(o.record_id) AS orphans
FROM refs r LEFT JOIN orphan o ON o.table_name = r.table_name AND o.record_id = r.record_id GROUP BY 1, 2""",
    "p5_found": f"""WITH {_TARGETS}, {_ENTRIES}
SELECT 'dependency_edge' AS table_name, name_key FROM tg WHERE name_key <> '' GROUP BY name_key HAVING count(*) >= {HEAVY} * (SELECT count(*) FROM tg WHERE name_key <> '')
UNION ALL
SELECT 'repository_object_record', name_key FROM en WHERE name_key <> '' GROUP BY name_key HAVING count(*) >= {HEAVY} * (SELECT count(*) FROM en WHERE name_key <> '')""",
    "p5_edge_targets": f"""WITH {_TARGETS}, g AS (SELECT name_key, seen_at, kind, epoch_us(seen_at) - epoch_us(lag(seen_at) OVER (PARTITION BY name_key ORDER BY seen_at NULLS FIRST, edge_id)) AS gap FROM tg WHERE name_key <> '')
SELECT name_key, count(*) AS n_rows, CAST(coalesce(sum(CASE WHEN lower(trim(kind)) = 'executes' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_executes, round(coalesce(max(gap) / 1e6, 0), 3) AS longest_gap_s FROM g GROUP BY name_key""",
    "p5_dependents": f"""WITH {_ENTRIES} SELECT name_key, count(*) AS n_entries, count(DISTINCT nullif({_KEY.format("entry")}, '')) AS n_dependents FROM en WHERE name_key <> '' GROUP BY name_key""",
    "p6_found": f"WITH RECURSIVE {TREE} SELECT n AS node_key, r AS root_key, CAST(d AS BIGINT) AS depth, CAST(cyc AS BIGINT) AS in_cycle FROM ans",
    "p6_paths": f"""WITH RECURSIVE {TREE} SELECT x.n AS node_key, coalesce(string_agg(w.a, ' > ' ORDER BY w.s DESC) || ' > ', '') || x.n AS path FROM ans x LEFT JOIN walk w ON w.n = x.n AND w.s <= x.d GROUP BY x.n""",
    "p6_descendants": f"WITH RECURSIVE {TREE} SELECT a AS ancestor, n AS descendant, CAST(min(s) AS BIGINT) AS steps FROM walk WHERE a <> n GROUP BY a, n",
}
