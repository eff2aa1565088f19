"""Objects that nothing refers to statically: candidates for review, never for deletion."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import fold
from skein.operators.closure import cycle_members, cycles
from skein.plans.graph import Graph
from skein.runtime import materialize

# Durable types, the type that counts as an entry by itself, and the reasons given.
DURABLE = ["stored procedure", "view", "function", "trigger", "table"]
IMPLICIT_ENTRIES = ["trigger"]
DECLARED = "component_contains_declared_entry_point"
IMPLICIT = "component_contains_implicit_entry_object"
REASON = "no_incoming_static_references_from_outside_component"


@dataclass(frozen=True)
class DeadObjects:
    """findings (component, members, is_circular_component, reason, external_usage_possible),
    exclusions (name, object_type, reason), the number of defined objects, canonical entry points."""

    findings: DataFrame
    exclusions: DataFrame
    defined: int
    entry_points: list[str]


def detect(graph: Graph, entry_points: Iterable[str] = (), found_cycles: DataFrame | None = None) -> DeadObjects:
    """Components of defined durable objects that no edge enters from outside.

    Objects on one loop form a component. A component with a declared entry
    point, or with a trigger, is excluded as a whole. An entry point that is no
    defined object raises ValueError.
    """
    spark = graph.nodes.sparkSession
    defined = graph.nodes.filter(fold(F.trim("object_type")).isin(DURABLE))
    asked = []
    for e in entry_points:
        if not e.strip():
            raise ValueError("SQL object name cannot be empty")
        asked.append(e)
    entries = spark.createDataFrame([(e,) for e in asked], "asked string").select("asked", fold(F.trim("asked")).alias("node_key"))
    known = {r["asked"]: r["name"] for r in entries.join(defined, "node_key").collect()} if asked else {}
    for e in asked:
        if e not in known:
            raise ValueError(f"Declared entry point is not a defined SQL object: {e}")
    found_cycles = cycles(graph) if found_cycles is None else found_cycles
    comp = cycle_members(found_cycles, graph)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("full"))
    mine = defined.join(comp, "node_key", "left").join(sizes, "component", "left")
    mine = materialize(
        mine.join(entries.select("node_key", F.lit(True).alias("declared")).distinct(), "node_key", "left").select(
            "node_key", "name", "object_type", F.coalesce("component", "node_key").alias("component"), "full", F.coalesce("declared", F.lit(False)).alias("declared")
        ),
        "defined",
    )
    of_dst = mine.select(F.col("node_key").alias("dst_key"), F.col("component").alias("into"))
    of_src = mine.select(F.col("node_key").alias("src_key"), F.col("component").alias("from"))
    entered = graph.edges.select("src_key", "dst_key").join(of_dst, "dst_key").join(of_src, "src_key", "left").filter("from is null or from <> into")
    roots = mine.join(entered.select(F.col("into").alias("component")).distinct(), "component", "left_anti")
    per = roots.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("node_key", "name", "object_type"))).alias("m"),
        F.bool_or("declared").alias("declared"),
        F.bool_or(fold("object_type").isin(IMPLICIT_ENTRIES)).alias("implicit"),
        (F.count(F.lit(1)) == F.max("full")).alias("whole"),
    )
    members = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["object_type"].alias("object_type")))
    per = materialize(per.select("component", members.alias("members"), "declared", "implicit", F.coalesce("whole", F.lit(False)).alias("is_circular_component")), "roots")
    findings = per.filter("not declared and not implicit").select("component", "members", "is_circular_component", F.lit(REASON).alias("reason"), F.lit(True).alias("external_usage_possible"))
    out = per.filter("declared or implicit").select(F.explode("members").alias("x"), F.when(F.col("declared"), DECLARED).otherwise(IMPLICIT).alias("reason"))
    return DeadObjects(findings, out.select("x.name", "x.object_type", "reason"), mine.count(), sorted(set(known.values()), key=str.casefold))
