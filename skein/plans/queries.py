"""Queries over corpora made from business tables, and over the stored sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.names import fold, name_key, normal_source_id
from skein.operators import closure, dead
from skein.plans import graph as g
from skein.plans import parse, report, repository, rules
from skein.plans.problems import TREE
from skein.runtime import load as scan
from skein.runtime import materialize, spread
from skein.sources import synthetic

ROOT = "dbo.R0"


def load(spark: SparkSession, d: str, *names: str):
    """Tables whose rows become texts, spread over the cores."""
    frames = scan(spark, d, *names)
    return spread(frames) if len(names) == 1 else tuple(map(spread, frames))


def _lineage_sources(spark: SparkSession, d: str, regions: bool = True) -> DataFrame:
    orders, customer, nation, region = load(spark, d, "orders", "customer", "nation", "region")
    return synthetic.lineage(orders, customer, nation, region if regions else None)


def _graph_of(sources: DataFrame) -> g.Graph:
    return g.build_graph(materialize(parse.parse_sources(sources), "objects"))


def _edges_of(sources: DataFrame) -> DataFrame:
    """Edges alone: the texts are read once, so nothing needs to be kept."""
    return g.build_graph(parse.parse_sources(sources)).edges


def _lineage(spark: SparkSession, d: str, regions: bool = True) -> g.Graph:
    return _graph_of(_lineage_sources(spark, d, regions))


def _procedures(spark: SparkSession, d: str) -> g.Graph:
    return _graph_of(synthetic.order_procedures(*load(spark, d, "orders", "customer")))


def _rings(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.event_rings(load(spark, d, "events"))


def corpus_edges(spark, d):
    return _edges_of(_lineage_sources(spark, d))


def graph_nodes(spark, d):
    return _lineage(spark, d, regions=False).nodes


def graph_union(spark, d):
    both = g.union_graphs(_graph_of(synthetic.nation_tables(load(spark, d, "nation"))), _graph_of(synthetic.supplier_triggers(*load(spark, d, "supplier", "nation"))))
    return g.named_edges(both).select("source", "target", "kind")


def get_node(spark, d):
    return g.get_node(_lineage(spark, d), " DBO.n3 ")


def dependencies_of(spark, d):
    return g.dependencies_of(_lineage(spark, d), "dbo.C7")


def dependents_of(spark, d):
    return g.dependents_of(_lineage(spark, d), "dbo.N3")


def cross_references(spark, d):
    return g.cross_references(_procedures(spark, d)).select("source", "target", "type")


def xref_outgoing(spark, d):
    return g.outgoing(_procedures(spark, d), "dbo.o1")


def xref_incoming(spark, d):
    return g.incoming(_procedures(spark, d), "DBO.C10")


def degrees(spark, d):
    return g.degrees(_lineage(spark, d)).drop("node_key")


def impact_region(spark, d):
    return closure.impact(_lineage(spark, d).cached(), ROOT)


def impact_paths(spark, d):
    return closure.impact_paths(_lineage(spark, d).cached(), ROOT).select(F.array_join("path", " > ").alias("path"))


def impact_tree(spark, d):
    """The tree of dependents below a region, one row for each node of it."""
    return closure.impact_tree(closure.impact_paths(_lineage(spark, d).cached(), ROOT)).select("parent", "name", "depth")


def graph_json_lines(spark, d):
    return report.graph_lines(_lineage(spark, d))


def cycles_events(spark, d):
    found = closure.cycles(_graph_of(_rings(spark, d)).cached())
    return found.select(F.array_join("members", ",").alias("members"), "is_self_reference", F.size("edges").cast("long").alias("n_edges"))


def dead_objects(spark, d):
    found = dead.detect(_lineage(spark, d).cached()).findings
    return found.select(F.explode("members").alias("m"), "is_circular_component", "reason").select("m.name", "m.object_type", "is_circular_component", "reason")


def dead_exclusions(spark, d):
    graph = _graph_of(synthetic.supplier_triggers(*load(spark, d, "supplier", "nation"))).cached()
    return dead.detect(graph, ["DBO.s1"]).exclusions


def _ring_rules(spark, d) -> rules.Result:
    objects = materialize(parse.parse_sources(_rings(spark, d)), "objects")
    return rules.Engine().run(rules.Context(g.build_graph(objects).cached(), objects))


def rule_findings(spark, d):
    found = _ring_rules(spark, d).findings
    return found.select("rule_id", "severity", "title", "message", F.array_join("objects", ",").alias("objects"))


def severity_counts(spark, d):
    return _ring_rules(spark, d).severity_counts()


def key_objects_top20(spark, d):
    ranked = g.degrees(_lineage(spark, d)).filter(F.col("object_type") != "Unknown").orderBy(F.col("dependent_count").desc(), "node_key")
    return ranked.limit(20).select("name", "object_type", "dependent_count")


def _part_repository(spark, d) -> repository.Repository:
    return repository.analyze(synthetic.part_procedures(load(spark, d, "part")))


def repository_summary(spark, d):
    return _part_repository(spark, d).summary()


def repository_objects(spark, d):
    rows = _part_repository(spark, d).object_records()
    return rows.select("name", "object_type", "source_id", "dynamic_sql", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"), F.col("dependency_count").cast("long"), F.col("dependent_count").cast("long"))


def object_inventory(spark, d):
    sources = synthetic.order_batches(load(spark, d, "lineitem"))
    named = g.with_node_name(parse.parse_sources(sources))
    per = named.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("object_ord", "node_name"))).alias("o"))
    return per.select("source_id", F.array_join("o.node_name", ",").alias("objects"))


def scope_isolation(spark, d):
    return _edges_of(synthetic.order_batches(load(spark, d, "lineitem")))


def statement_counts(spark, d):
    """Statements of the latest state of every stored source that holds any."""
    rows = parse.tokens(_latest_states(spark, d))
    return rows.filter("value <> ';'").groupBy("source_id").agg(F.count_distinct("stmt_no").alias("statements"))


def token_kinds(spark, d):
    """Tokens of all stored texts by kind."""
    return parse.tokens(load(spark, d, "sql_source")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def fk_edges(spark, d):
    return _edges_of(synthetic.nation_tables(load(spark, d, "nation")))


def reference_forms(spark, d):
    return _edges_of(synthetic.line_forms(load(spark, d, "lineitem")))


def temporary_tables(spark, d):
    objects = parse.parse_sources(synthetic.line_forms(load(spark, d, "lineitem")))
    return objects.select("name", F.explode("temporary_tables").alias("temporary_table"))


def parameters(spark, d):
    objects = parse.parse_sources(synthetic.part_procedures(load(spark, d, "part")))
    return objects.select(F.col("name").alias("object_name"), F.explode("parameters").alias("p")).select("object_name", "p.*")


def variables(spark, d):
    objects = parse.parse_sources(synthetic.part_procedures(load(spark, d, "part")))
    return objects.select(F.col("name").alias("object_name"), F.explode("variables").alias("v")).select("object_name", F.col("v.name").alias("variable"))


def dynamic_sql(spark, d):
    objects = parse.parse_sources(synthetic.part_procedures(load(spark, d, "part")))
    return objects.filter("dynamic_sql").select("source_id", "name", "schema")


def lint_counts(spark, d):
    rows = load(spark, d, "sql_source").select("source_id", "sql_text")
    return parse.lint_counts(rows).groupBy("rule").agg(F.sum("matches").alias("matches"))


def _classed_files(spark, d) -> DataFrame:
    """(path, kind) of every file entry, rescans counted once; a null content is the stored source's text of that path."""
    own = load(spark, d, "sql_file_entry").filter("path is not null").groupBy("path").agg(F.max("content").alias("content"))
    stored = _latest_states(spark, d).select(F.col("source_id").alias("key"), parse.file_kind(F.col("sql_text")).alias("stored_kind"))
    rows = own.select("path", F.when(F.col("content").isNotNull(), parse.file_kind(F.col("content"))).alias("own_kind"), normal_source_id("path").alias("key"))
    return rows.join(stored, "key", "left").select("path", F.coalesce("own_kind", "stored_kind", F.lit("Script")).alias("kind"))


def file_kinds(spark, d):
    """File entries by the kind of their text."""
    return _classed_files(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scan_summary(spark, d):
    return parse.kind_summary(_classed_files(spark, d))


def script_scopes(spark, d):
    """What the scripts of a file hold together: variables and references in order of first sight."""
    objects = parse.parse_sources(synthetic.supplier_scripts(load(spark, d, "supplier")))
    return objects.select("source_id", "object_ord", "name", F.array_join("variables.name", ",").alias("variables"), F.array_join("references.name", ",").alias("refs"))


def _latest_states(spark, d) -> DataFrame:
    """The latest state of every stored source, in whatever language."""
    rows = load(spark, d, "sql_source").withColumn("source_id", normal_source_id("source_id"))
    per = rows.groupBy("source_id").agg(F.max_by(F.struct("sql_text", "lang", "path"), F.struct("committed_at", "sql_text")).alias("s"))
    return per.select("source_id", "s.*")


def _stored_sources(spark, d) -> DataFrame:
    """The latest state of every stored T-SQL source."""
    return _latest_states(spark, d).filter("lang = 'tsql'")


def source_ids(spark, d):
    return _stored_sources(spark, d).select("source_id")


def stored_objects(spark, d):
    """What every stored source defines."""
    rows = g.with_node_name(parse.parse_sources(_stored_sources(spark, d)))
    return rows.select("source_id", "object_ord", "node_name", "object_type", F.size("parameters").alias("parameters"), F.size("references").alias("refs"), "dynamic_sql")


def stored_edges(spark, d):
    return _edges_of(_stored_sources(spark, d))


def stored_cycles(spark, d):
    found = closure.cycles(_graph_of(_stored_sources(spark, d)).cached())
    return found.select(F.array_join("members", ",").alias("members"), "is_self_reference", F.size("edges").alias("n_edges"))


def _edge_graph(spark, d) -> g.Graph:
    """The graph of the stored dependency rows."""
    rows = load(spark, d, "dependency_edge").select(name_key("source").alias("src_key"), name_key("target").alias("dst_key"), F.lower(F.trim("kind")).alias("kind"))
    edges = rows.filter("src_key is not null and dst_key is not null").distinct()
    keys = edges.select(F.explode(F.array("src_key", "dst_key")).alias("node_key")).distinct()
    return g.Graph(keys.select("node_key", F.col("node_key").alias("name"), F.lit("Unknown").alias("object_type")), edges)


def edge_cross_references(spark, d):
    return g.cross_references(_edge_graph(spark, d)).select("source", "target", "type")


def edge_degrees(spark, d):
    return g.degrees(_edge_graph(spark, d)).select("name", "dependency_count", "dependent_count")


def edge_cycles(spark, d):
    """Loops of executes rows."""
    graph = _edge_graph(spark, d)
    found = closure.cycles(g.Graph(graph.nodes, graph.edges.filter("kind = 'executes'")).cached())
    return found.select(F.array_join("members", ",").alias("members"), "is_self_reference", F.size("edges").cast("long").alias("n_edges"))


def folded_names(spark, d):
    return load(spark, d, "dependency_node").select("node_id", fold(F.trim("name")).alias("name_key")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        corpus_edges, graph_nodes, graph_union, get_node, dependencies_of, dependents_of, cross_references, xref_outgoing, xref_incoming,
        degrees, impact_region, impact_paths, impact_tree, graph_json_lines, cycles_events, dead_objects, dead_exclusions, rule_findings, severity_counts,
        key_objects_top20, repository_summary, repository_objects, object_inventory, scope_isolation, statement_counts, token_kinds,
        fk_edges, reference_forms, temporary_tables, parameters, variables, script_scopes, dynamic_sql, lint_counts, file_kinds, scan_summary,
        source_ids, stored_objects, stored_edges, stored_cycles, edge_cross_references, edge_degrees, edge_cycles, folded_names,
    )
}

_LINEAGE = """e AS (
 SELECT 'dbo.O' || o_orderkey AS source, 'dbo.C' || o_custkey AS target FROM orders UNION ALL
 SELECT 'dbo.C' || c_custkey, 'dbo.N' || c_nationkey FROM customer UNION ALL
 SELECT 'dbo.N' || n_nationkey, 'dbo.R' || n_regionkey FROM nation),
views AS (SELECT 'dbo.O' || o_orderkey AS name FROM orders UNION SELECT 'dbo.C' || c_custkey FROM customer UNION SELECT 'dbo.N' || n_nationkey FROM nation),
tabs AS (SELECT 'dbo.R' || r_regionkey AS name FROM region)"""
_ALL_NODES = f"""WITH {_LINEAGE}, n AS (SELECT name FROM views UNION SELECT name FROM tabs UNION SELECT target FROM e),
t AS (SELECT name, CASE WHEN name IN (SELECT name FROM views) THEN 'View' WHEN name IN (SELECT name FROM tabs) THEN 'Table' ELSE 'Unknown' END AS object_type FROM n)"""
_RINGS = """r AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
m AS (SELECT user_id, n, unnest(range(1, n + 1)) AS i FROM r),
ring AS (SELECT user_id, n, string_agg('dbo.U' || user_id || '_' || i, ',' ORDER BY i::VARCHAR) AS members FROM m GROUP BY 1, 2)"""
_FINDINGS = f"""WITH {_RINGS}, f AS (
 SELECT 'SQL001' AS rule_id, 'error' AS severity, 'Circular dependency' AS title, (CASE WHEN n = 1 THEN 'Self-referencing SQL object detected: ' ELSE 'Circular dependency component detected: ' END) || replace(members, ',', ', ') AS message, members AS objects FROM ring WHERE user_id % 2 = 0
 UNION ALL SELECT 'SQL002', 'warning', 'Dead object candidate', 'Unreferenced SQL component requires review: ' || replace(members, ',', ', '), members FROM ring WHERE user_id % 2 = 0
 UNION ALL SELECT 'SQL002', 'warning', 'Dead object candidate', 'Unreferenced SQL component requires review: dbo.U' || user_id || '_1', 'dbo.U' || user_id || '_1' FROM ring WHERE user_id % 2 = 1)"""
_NK = "lower(trim({0}, ' ' || chr(9)))"
_EDGES = f"""e AS (SELECT DISTINCT {_NK.format("source")} AS s, {_NK.format("target")} AS t, lower(trim(kind)) AS kind FROM dependency_edge WHERE {_NK.format("source")} <> '' AND {_NK.format("target")} <> '')"""
_LINES = """f AS (SELECT 'script:lines/' || l_orderkey || '_' || l_linenumber || '.sql' AS s, l_returnflag AS f, 'dbo.p' || l_partkey AS p, 'dbo.s' || l_suppkey AS su FROM lineitem)"""
_KIND = r"""CASE WHEN regexp_matches(content, '(?i)\bCREATE\s+(OR\s+ALTER\s+)?PROCEDURE\b') THEN 'Stored Procedure' WHEN regexp_matches(content, '(?i)\bCREATE\s+VIEW\b') THEN 'View' WHEN regexp_matches(content, '(?i)\bCREATE\s+FUNCTION\b') THEN 'Function' ELSE 'Script' END"""
_SID = r"regexp_replace(replace(trim({0}), chr(92), '/'), '^(\./)+', '')"
_LATEST = f"""st AS (SELECT {_SID.format("source_id")} AS sid, arg_max(coalesce(sql_text, chr(0)), (committed_at, coalesce(sql_text, ''))) AS x FROM sql_source GROUP BY 1)"""
_FILES = f"""{_LATEST}, f AS (SELECT path, max(content) AS own FROM sql_file_entry WHERE path IS NOT NULL GROUP BY path),
k AS (SELECT {_KIND} AS kind FROM (SELECT coalesce(own, x, '') AS content FROM f LEFT JOIN st ON sid = {_SID.format("path")}))"""
# Lexemes as RE2 reads them: a line break is taken alone, so that GO alone on its line can be told first.
_BLANK = r"[^\S\n]|[\x0b\x1c-\x1f\x85\p{Z}]"
_WORD = r"\[[^\]]*(?:\]\][^\]]*)*\]?|[\p{L}\p{N}_$]+"
_LEXEMES = rf"\n(?:{_BLANK})*[Gg][Oo](?:{_BLANK})*(?m:$)|\n|(?:{_BLANK})+|--[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)|[(),;]|''[^'']*(?:''''[^'']*)*''?|\"[^\"]*(?:\"\"[^\"]*)*\"?|[#@][\p{{L}}\p{{N}}._$]*|(?:{_WORD})(?:\.(?:{_WORD}))*|(?s:.)"
# Of a block comment that never ends, the last character remains a token; a GO line and blanks give none.
_TOKEN_OF = r"""CASE WHEN regexp_full_match(m, '\n(?s:.*)[Gg][Oo](?s:.*)') THEN 'GO' WHEN regexp_full_match(m, '(?:[\s\x0b\x1c-\x1f\x85\p{Z}])+') OR m[1:2] = '--' OR (m[1:2] = '/*' AND len(m) > 3 AND m[-2:] = '*/') THEN ''
 WHEN m[1:2] = '/*' THEN CASE WHEN len(m) = 2 THEN '' ELSE m[-1] END ELSE m END"""
_LEXED = f"""lx AS (SELECT sid, unnest(regexp_extract_all(chr(10) || x, '{_LEXEMES}')) AS m FROM texts), tk AS (SELECT sid, {_TOKEN_OF} AS v FROM lx)"""

ORACLES = {
    "corpus_edges": f"WITH {_LINEAGE} SELECT DISTINCT lower(source) AS src_key, lower(target) AS dst_key, 'references' AS kind FROM e",
    "graph_nodes": f"""WITH {_LINEAGE}, n AS (SELECT name FROM views UNION SELECT target FROM e)
SELECT lower(name) AS node_key, CASE WHEN name IN (SELECT name FROM views) OR name NOT LIKE 'dbo.N%' THEN name ELSE replace(name, 'dbo.', 'DBO.') END AS name, CASE WHEN name IN (SELECT name FROM views) THEN 'View' ELSE 'Unknown' END AS object_type FROM n""",
    "graph_union": """SELECT 'dbo.N' || n_nationkey AS source, 'dbo.R' || n_regionkey AS target, 'references' AS kind FROM nation
UNION SELECT 'dbo.S' || s_suppkey, 'dbo.N' || s_nationkey, 'references' FROM supplier""",
    "get_node": "SELECT 'dbo.n3' AS node_key, 'dbo.N3' AS name, 'View' AS object_type FROM nation WHERE n_nationkey = 3",
    "dependencies_of": "SELECT 'dbo.N' || c_nationkey AS name, 'View' AS object_type, 'references' AS kind FROM customer WHERE c_custkey = 7",
    "dependents_of": "SELECT 'dbo.C' || c_custkey AS name, 'View' AS object_type, 'references' AS kind FROM customer WHERE c_nationkey = 3",
    "cross_references": "SELECT DISTINCT 'dbo.O' || o_orderkey AS source, 'dbo.C' || o_custkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'execute' ELSE 'read' END AS type FROM orders",
    "xref_outgoing": "SELECT DISTINCT 'dbo.O' || o_orderkey AS source, 'dbo.C' || o_custkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'execute' ELSE 'read' END AS type FROM orders WHERE o_orderkey = 1",
    "xref_incoming": "SELECT DISTINCT 'dbo.O' || o_orderkey AS source, 'dbo.C' || o_custkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'execute' ELSE 'read' END AS type FROM orders WHERE o_custkey = 10",
    "degrees": f"""{_ALL_NODES}, u AS (SELECT DISTINCT * FROM e), o AS (SELECT source AS name, count(*) AS c FROM u GROUP BY 1), i AS (SELECT target AS name, count(*) AS c FROM u GROUP BY 1)
SELECT t.name, t.object_type, coalesce(o.c, 0) AS dependency_count, coalesce(i.c, 0) AS dependent_count FROM t LEFT JOIN o USING (name) LEFT JOIN i USING (name)""",
    "impact_region": """WITH n AS (SELECT 'dbo.N' || n_nationkey AS name, n_nationkey AS k, row_number() OVER (ORDER BY lower('dbo.N' || n_nationkey)) AS o FROM nation WHERE n_regionkey = 0),
cu AS (SELECT 'dbo.C' || c_custkey AS name, c_custkey AS k, row_number() OVER (ORDER BY n.o, lower('dbo.C' || c_custkey)) + (SELECT count(*) FROM n) AS o FROM customer JOIN n ON n.k = c_nationkey),
od AS (SELECT 'dbo.O' || o_orderkey AS name, row_number() OVER (ORDER BY cu.o, lower('dbo.O' || o_orderkey)) + (SELECT count(*) FROM n) + (SELECT count(*) FROM cu) AS o FROM orders JOIN cu ON cu.k = o_custkey)
SELECT 0 AS ord, 'dbo.R0' AS name, 0 AS depth UNION ALL SELECT o, name, 1 FROM n UNION ALL SELECT o, name, 2 FROM cu UNION ALL SELECT o, name, 3 FROM od""",
    "impact_paths": """SELECT 'dbo.R0' AS path UNION ALL SELECT 'dbo.R0 > dbo.N' || n_nationkey FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'dbo.R0 > dbo.N' || n_nationkey || ' > dbo.C' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 0
UNION ALL SELECT 'dbo.R0 > dbo.N' || n_nationkey || ' > dbo.C' || c_custkey || ' > dbo.O' || o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 0""",
    "impact_tree": """SELECT NULL AS parent, 'dbo.R0' AS name, 0 AS depth UNION ALL SELECT 'dbo.R0', 'dbo.N' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'dbo.N' || n_nationkey, 'dbo.C' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 0
UNION ALL SELECT 'dbo.C' || c_custkey, 'dbo.O' || o_orderkey, 3 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 0""",
    "graph_json_lines": f"""{_ALL_NODES} SELECT 'node' AS part, '{{"name":"' || name || '","object_type":"' || object_type || '"}}' AS line FROM t
UNION ALL SELECT DISTINCT 'edge', '{{"source":"' || source || '","target":"' || target || '","kind":"references"}}' FROM e""",
    "cycles_events": f"WITH {_RINGS} SELECT members, n = 1 AS is_self_reference, n AS n_edges FROM ring WHERE user_id % 2 = 0",
    "dead_objects": f"""{_ALL_NODES} SELECT name, object_type, false AS is_circular_component, '{dead.REASON}' AS reason FROM t WHERE object_type <> 'Unknown' AND name NOT IN (SELECT target FROM e)""",
    "dead_exclusions": f"""SELECT 'dbo.S' || s_suppkey AS name, 'Trigger' AS object_type, CASE WHEN s_suppkey = 1 THEN '{dead.DECLARED}' ELSE '{dead.IMPLICIT}' END AS reason FROM supplier""",
    "rule_findings": f"{_FINDINGS} SELECT * FROM f",
    "severity_counts": f"{_FINDINGS} SELECT severity, count(*) AS n FROM f GROUP BY severity",
    "key_objects_top20": f"""{_ALL_NODES}, i AS (SELECT target AS name, count(*) AS c FROM (SELECT DISTINCT * FROM e) GROUP BY 1)
SELECT name, object_type, coalesce(c, 0) AS dependent_count FROM t LEFT JOIN i USING (name) WHERE object_type <> 'Unknown' ORDER BY dependent_count DESC, lower(name) LIMIT 20""",
    "repository_summary": """SELECT count(*) AS source_count, 2 * count(*) AS parsed_object_count, count(*) AS durable_object_count, count(*) AS script_object_count, 3 * count(*) + 1 AS graph_node_count, 2 * count(*) AS dependency_edge_count,
0 AS circular_component_count, count(*) AS dead_object_candidate_count, count(*) AS dead_object_candidate_object_count, count(*) AS finding_count, 0 AS error_count, count(*) AS warning_count, 0 AS info_count, count(*) FILTER (p_size % 2 = 0) AS dynamic_sql_object_count FROM part""",
    "repository_objects": """SELECT 'dbo.P' || p_partkey AS name, 'Stored Procedure' AS object_type, 'parts/' || p_partkey || '.sql' AS source_id, p_size % 2 = 0 AS dynamic_sql, 'dbo.Parts' AS dependencies, '' AS dependents, 1 AS dependency_count, 0 AS dependent_count FROM part
UNION ALL SELECT 'script:parts/' || p_partkey || '.sql', 'Script', 'parts/' || p_partkey || '.sql', false, 'dbo.After' || p_partkey, '', 1, 0 FROM part""",
    "object_inventory": "SELECT 'batches/' || l_orderkey || '.sql' AS source_id, string_agg('dbo.L' || l_orderkey || '_' || l_linenumber, ',' ORDER BY l_linenumber) AS objects FROM lineitem GROUP BY l_orderkey",
    "scope_isolation": """SELECT DISTINCT 'dbo.l' || l_orderkey || '_' || l_linenumber AS src_key, 'dbo.p' || l_partkey AS dst_key, 'references' AS kind FROM lineitem
UNION ALL SELECT DISTINCT 'dbo.l' || l_orderkey || '_' || l_linenumber, 'dbo.s' || l_suppkey, 'executes' FROM lineitem""",
    "statement_counts": f"""WITH {_LATEST}, texts AS (SELECT * FROM st WHERE x <> chr(0)), mm AS (SELECT sid, regexp_extract_all(chr(10) || x, '{_LEXEMES}') AS ms FROM texts),
sg AS (SELECT sid, array_to_string(list_transform(list_transform(ms, lambda m: {_TOKEN_OF}), lambda v: CASE WHEN trim(v) = '' THEN '' WHEN v IN (';', 'GO') THEN v ELSE 't' END), '') AS line FROM mm)
SELECT sid AS source_id, CAST(len(regexp_extract_all(line, 't+')) AS BIGINT) AS statements FROM sg WHERE contains(line, 't')""",
    "token_kinds": rf"""WITH texts AS (SELECT 0 AS sid, sql_text AS x FROM sql_source WHERE sql_text IS NOT NULL), {_LEXED}
SELECT CASE WHEN v IN ('(', ')', ',', ';') THEN 'symbol' WHEN v[1] IN ('''', '"') THEN 'literal' WHEN regexp_matches(v, '^[#@\[\p{{L}}\p{{N}}_$]') THEN 'identifier' ELSE 'operator' END AS kind, count(*) AS n FROM tk WHERE v <> 'GO' AND trim(v) <> '' GROUP BY 1""",
    "fk_edges": "SELECT 'dbo.n' || n_nationkey AS src_key, 'dbo.r' || n_regionkey AS dst_key, 'references' AS kind FROM nation",
    "reference_forms": f"WITH {_LINES} SELECT DISTINCT s AS src_key, p AS dst_key, 'references' AS kind FROM f UNION SELECT s, su, 'references' FROM f WHERE f <> 'N'",
    "temporary_tables": f"WITH {_LINES} SELECT s AS name, unnest(CASE WHEN f = 'A' THEN ['#t', '#'] ELSE ['#tmp', '#'] END) AS temporary_table FROM f WHERE f IN ('A', 'N')",
    "parameters": """SELECT 'P' || p_partkey AS object_name, unnest(['@Id', '@Size', '@Name']) AS name, unnest(['bigint', 'decimal', 'nvarchar']) AS datatype, unnest([NULL, p_size::VARCHAR, 'NULL']) AS default_value, unnest([false, false, true]) AS output FROM part""",
    "variables": "SELECT 'P' || p_partkey AS object_name, unnest(['@Local' || p_size, '@Other']) AS variable FROM part",
    "dynamic_sql": "SELECT 'parts/' || p_partkey || '.sql' AS source_id, 'P' || p_partkey AS name, 'dbo' AS schema FROM part WHERE p_size % 2 = 0",
    "lint_counts": r"""WITH t AS (SELECT coalesce(sql_text, '') AS x FROM sql_source)
SELECT 'SELECT_STAR' AS rule, CAST(sum(len(regexp_extract_all(x, '(?i)SELECT\s+\*'))) AS BIGINT) AS matches FROM t
UNION ALL SELECT 'NOCOUNT', CAST(sum(len(regexp_extract_all(x, '(?i)SET\s+NOCOUNT\s+ON'))) AS BIGINT) FROM t
UNION ALL SELECT 'CURSOR', CAST(sum(len(regexp_extract_all(x, '(?i)\bCURSOR\b'))) AS BIGINT) FROM t
UNION ALL SELECT 'TEMP_TABLE', CAST(sum(len(regexp_extract_all(x, '#[\p{L}\p{N}_]+'))) AS BIGINT) FROM t
UNION ALL SELECT 'DYNAMIC_SQL', CAST(sum(len(regexp_extract_all(x, '(?i)sp_executesql|EXEC\s*\('))) AS BIGINT) FROM t""",
    "file_kinds": f"WITH {_FILES} SELECT kind, count(*) AS n FROM k GROUP BY 1",
    "scan_summary": f"""WITH {_FILES}
SELECT count(*) AS total_sql_files, count(*) FILTER (kind = 'Stored Procedure') AS stored_procedures, count(*) FILTER (kind = 'View') AS views, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Script') AS scripts FROM k""",
    "script_scopes": """SELECT 'scripts/' || s_suppkey || '.sql' AS source_id, 0 AS object_ord, 'script:scripts/' || s_suppkey || '.sql' AS name, '@First' || s_suppkey || ',@Second,@Third' AS variables, 'Before' || s_suppkey || ',Middle' || s_nationkey || ',After' || s_suppkey AS refs FROM supplier
UNION ALL SELECT 'scripts/' || s_suppkey || '.sql', 1, 'Local' || s_suppkey, '', '' FROM supplier""",
    "source_ids": r"""SELECT sid AS source_id FROM (SELECT regexp_replace(replace(trim(source_id), chr(92), '/'), '^(\./)+', '') AS sid, lang, committed_at FROM sql_source) GROUP BY sid HAVING arg_max(lang, committed_at) = 'tsql'""",
    "edge_cross_references": f"WITH {_EDGES} SELECT s AS source, t AS target, CASE kind WHEN 'executes' THEN 'execute' ELSE 'read' END AS type FROM e",
    "edge_degrees": f"""WITH {_EDGES}, k AS (SELECT s AS name, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e)
SELECT name, CAST(sum(o) AS BIGINT) AS dependency_count, CAST(sum(i) AS BIGINT) AS dependent_count FROM k GROUP BY name""",
    "edge_cycles": f"WITH RECURSIVE {TREE} SELECT string_agg(n, ',' ORDER BY n) AS members, count(*) = 1 AS is_self_reference, count(*) AS n_edges FROM loopkey GROUP BY k",
    "folded_names": "SELECT DISTINCT node_id, lower(trim(name, ' ' || chr(9))) AS name_key FROM dependency_node",
}
