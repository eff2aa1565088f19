"""The whole analysis of a repository: one parse, one graph, every product."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import fold
from skein.operators.dead import DURABLE
from skein.plans.graph import Graph, build_graph, named_edges, with_node_name
from skein.plans.parse import canonical_sources, parse_sources
from skein.plans.rules import Context, Engine, Result, normal_entry_points
from skein.runtime import materialize


@dataclass(frozen=True)
class Repository:
    sources: DataFrame
    objects: DataFrame
    graph: Graph
    result: Result
    entry_points: list[str]

    @property
    def context(self) -> Context:
        return self.result.context

    def source_inventory(self) -> DataFrame:
        """(source_id, path, objects): each source's object names in order; a source without objects has an empty list."""
        per = with_node_name(self.objects).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("object_ord", "node_name"))).alias("o"))
        return self.sources.join(per, "source_id", "left").select("source_id", "path", F.coalesce(F.col("o.node_name"), F.array().cast("array<string>")).alias("objects"))

    def object_records(self) -> DataFrame:
        """One row for each object record with its dependency and dependent names, an entry for each edge."""
        edges = named_edges(self.graph)
        deps = edges.groupBy(F.col("src_key").alias("node_key")).agg(F.array_sort(F.collect_list(F.struct("dst_key", "kind", "target"))).alias("d"))
        users = edges.groupBy(F.col("dst_key").alias("node_key")).agg(F.array_sort(F.collect_list(F.struct("src_key", "kind", "source"))).alias("u"))
        none = F.array().cast("array<string>")
        own = with_node_name(self.objects).select("source_id", "object_ord", F.col("node_name").alias("name"), "object_type", "dynamic_sql", fold("node_name").alias("node_key"))
        return (
            own.join(deps, "node_key", "left")
            .join(users, "node_key", "left")
            .select("name", "object_type", "source_id", "object_ord", "dynamic_sql", F.coalesce(F.col("d.target"), none).alias("dependencies"), F.coalesce(F.col("u.source"), none).alias("dependents"))
            .withColumns({"dependency_count": F.size("dependencies"), "dependent_count": F.size("dependents")})
        )

    def key_objects(self, limit: int | None = None) -> DataFrame:
        """Object records by falling number of dependents, then name."""
        ordered = self.object_records().orderBy(F.col("dependent_count").desc(), fold("name"))
        return ordered if limit is None else ordered.limit(limit)

    def summary(self) -> DataFrame:
        """One row of the counts over the whole result."""
        spark = self.objects.sparkSession
        kinds = fold(F.trim("object_type"))
        o = self.objects.agg(
            F.count(F.lit(1)).alias("parsed_object_count"),
            F.count_if(kinds.isin(DURABLE)).alias("durable_object_count"),
            F.count_if(kinds == "script").alias("script_object_count"),
            F.count_if("dynamic_sql").alias("dynamic_sql_object_count"),
        ).first()
        f = self.result.findings.agg(F.count(F.lit(1)).alias("finding_count"), *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")]).first()
        d = self.context.dead.findings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first()
        row = {
            "source_count": self.sources.count(),
            "parsed_object_count": o["parsed_object_count"],
            "durable_object_count": o["durable_object_count"],
            "script_object_count": o["script_object_count"],
            "graph_node_count": self.graph.nodes.count(),
            "dependency_edge_count": self.graph.edges.count(),
            "circular_component_count": self.context.cycles.count(),
            "dead_object_candidate_count": d["n"],
            "dead_object_candidate_object_count": d["m"],
            **f.asDict(),
            "dynamic_sql_object_count": o["dynamic_sql_object_count"],
        }
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))


def analyze(sources: DataFrame, entry_points: Iterable[str] = (), rule_ids: Iterable[str] = (), engine: Engine | None = None) -> Repository:
    """Parse once, build one graph, find cycles and dead objects once, run the rules.

    Duplicate source ids in any letter case and blank entry points raise ValueError.
    """
    entries = normal_entry_points(entry_points)
    sources = canonical_sources(sources)
    objects = materialize(parse_sources(sources), "objects")
    graph = build_graph(objects).cached()
    result = (engine or Engine()).run(Context(graph, objects, entries), rule_ids)
    return Repository(sources.select("source_id", "path"), objects, graph, result, entries)
