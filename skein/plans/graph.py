"""The dependency graph of parsed objects, its lookups and cross references.

A graph is a pair of tables: nodes (node_key, name, object_type) and edges
(src_key, dst_key, kind). Keys are the folded names; an edge points from an
object to what it depends on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.names import fold
from skein.runtime import materialize

# The type under which an edge appears as a cross reference.
XREF_TYPES = {"references": "read", "executes": "execute"}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def cached(self) -> Graph:
        """The same graph, written once to the shared folder for the jobs to come."""
        return Graph(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"))


def _joined(*parts: str) -> Column:
    # Blank parts are skipped.
    return F.concat_ws(".", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def with_node_name(objects: DataFrame) -> DataFrame:
    """``objects`` plus ``node_name``: schema and name; the database of a definition does not count."""
    return objects.withColumn("node_name", _joined("schema", "name"))


def build_graph(objects: DataFrame, doc_order: Column | None = None) -> Graph:
    """Nodes and edges of parsed objects.

    Definitions of all sources register before any reference, and the first to
    register gives a node its spelling and type; references to what nothing
    defines are Unknown. ``doc_order`` orders the sources (default: folded
    source_id). One node for each key, one edge for each (source, target, kind).
    """
    doc = fold("source_id") if doc_order is None else doc_order
    own = with_node_name(objects).select("node_name", "object_type", doc.alias("doc"), "object_ord", "references")
    defined = own.select(fold("node_name").alias("node_key"), F.col("node_name").alias("name"), "object_type", F.struct(F.lit(0).alias("turn"), "doc", "object_ord", F.lit(-1).alias("ref_ord")).alias("ord"))
    refs = own.select(F.col("node_name").alias("source"), "doc", "object_ord", F.posexplode("references").alias("ref_ord", "r"))
    refs = refs.select("source", "doc", "object_ord", "ref_ord", _joined("r.database", "r.schema", "r.name").alias("target"), F.when(fold("r.kind") == "call", "executes").otherwise("references").alias("kind"))
    named = refs.select(fold("target").alias("node_key"), F.col("target").alias("name"), F.lit("Unknown").alias("object_type"), F.struct(F.lit(1).alias("turn"), "doc", "object_ord", "ref_ord").alias("ord"))
    nodes = defined.unionByName(named).groupBy("node_key").agg(F.min_by(F.struct("name", "object_type"), "ord").alias("n")).select("node_key", "n.name", "n.object_type")
    edges = refs.select(fold("source").alias("src_key"), fold("target").alias("dst_key"), "kind").distinct()
    return Graph(nodes, edges)


def union_graphs(first: Graph, second: Graph) -> Graph:
    """Both graphs as one; where both know a node, the first one's spelling and type stay."""
    both = first.nodes.withColumn("o", F.lit(0)).unionByName(second.nodes.withColumn("o", F.lit(1)))
    nodes = both.groupBy("node_key").agg(F.min_by(F.struct("name", "object_type"), "o").alias("n")).select("node_key", "n.name", "n.object_type")
    return Graph(nodes, first.edges.unionByName(second.edges).distinct())


def _key(name: str) -> Column:
    if not name or not name.strip():
        raise ValueError("SQL object name cannot be empty")
    return fold(F.lit(name.strip()))


def get_node(graph: Graph, name: str) -> DataFrame:
    """The node of that name in any letter case, or no row."""
    return graph.nodes.filter(F.col("node_key") == _key(name))


def dependencies_of(graph: Graph, name: str) -> DataFrame:
    """(name, object_type, kind) of what ``name`` depends on, one row for each edge."""
    mine = graph.edges.filter(F.col("src_key") == _key(name))
    return mine.join(graph.nodes, mine.dst_key == graph.nodes.node_key).select("name", "object_type", "kind")


def dependents_of(graph: Graph, name: str) -> DataFrame:
    """(name, object_type, kind) of what depends on ``name``, one row for each edge."""
    mine = graph.edges.filter(F.col("dst_key") == _key(name))
    return mine.join(graph.nodes, mine.src_key == graph.nodes.node_key).select("name", "object_type", "kind")


def named_edges(graph: Graph) -> DataFrame:
    """(source, target, kind, src_key, dst_key) with the nodes' spellings."""
    src = graph.nodes.select(F.col("node_key").alias("src_key"), F.col("name").alias("source"))
    dst = graph.nodes.select(F.col("node_key").alias("dst_key"), F.col("name").alias("target"))
    return graph.edges.join(src, "src_key").join(dst, "dst_key").select("source", "target", "kind", "src_key", "dst_key")


def cross_references(graph: Graph) -> DataFrame:
    """(source, target, type) of every edge; an edge reads or executes."""
    kind = F.create_map(*[F.lit(x) for kv in XREF_TYPES.items() for x in kv])
    return named_edges(graph).select("source", "target", kind[F.col("kind")].alias("type"), "src_key", "dst_key")


def outgoing(graph: Graph, name: str) -> DataFrame:
    """Cross references that start at ``name``."""
    return cross_references(Graph(graph.nodes, graph.edges.filter(F.col("src_key") == _key(name)))).select("source", "target", "type")


def incoming(graph: Graph, name: str) -> DataFrame:
    """Cross references that end at ``name``."""
    return cross_references(Graph(graph.nodes, graph.edges.filter(F.col("dst_key") == _key(name)))).select("source", "target", "type")


def degrees(graph: Graph) -> DataFrame:
    """(node_key, name, object_type, dependency_count, dependent_count); edges count, not distinct neighbours.

    One pass over the edges: both ends are counted in one pre-aggregated group-by.
    """
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src_key").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_key").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy(F.col("e.k").alias("node_key")).agg(F.sum("e.o").alias("dependency_count"), F.sum("e.i").alias("dependent_count"))
    zero = F.lit(0).cast("long")
    return graph.nodes.join(n, "node_key", "left").select("node_key", "name", "object_type", F.coalesce("dependency_count", zero).alias("dependency_count"), F.coalesce("dependent_count", zero).alias("dependent_count"))
