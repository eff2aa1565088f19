"""Graphs, closures, dead objects, rules, reports, files and the command line."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from skein import cli
from skein.operators import closure, dead
from skein.plans import graph as g
from skein.plans import parse, queries, report, repository, rules
from skein.sources import files, synthetic


@pytest.fixture(scope="module")
def make(spark):
    def graph(edges, types=None):
        """A graph of (source, target[, kind]) by way of T-SQL texts."""
        types = types or {}
        out = [(s, t, *(k or ["references"])) for s, t, *k in edges]
        node = sorted({n for s, t, _ in out for n in (s, t)} | set(types))
        nodes = spark.createDataFrame([(n.casefold(), n, types.get(n, "View")) for n in node], "node_key string, name string, object_type string").dropDuplicates(["node_key"])
        rows = spark.createDataFrame([(s.casefold(), t.casefold(), k) for s, t, k in out], "src_key string, dst_key string, kind string").distinct()
        return g.Graph(nodes, rows)

    return graph


def sources(spark, **texts):
    return files.memory_sources(spark, [(k.replace("__", "/"), v) for k, v in texts.items()])


def test_graph_first_spelling_and_definitions_win(spark):
    s = sources(spark, a="CREATE VIEW dbo.Alpha AS SELECT * FROM DBO.BETA", b="CREATE VIEW dbo.Beta AS SELECT * FROM dbo.ALPHA; ", c="CREATE TABLE DBO.ALPHA (i int)", d="EXEC other.dbo.P; SELECT 1 FROM other.dbo.p")
    graph = g.build_graph(parse.parse_sources(s))
    assert {(r["node_key"], r["name"], r["object_type"]) for r in graph.nodes.collect()} == {
        ("dbo.alpha", "dbo.Alpha", "View"), ("dbo.beta", "dbo.Beta", "View"), ("script:d", "script:d", "Script"), ("other.dbo.p", "other.dbo.P", "Unknown"),
    }
    assert sorted((r["type"], r["target"]) for r in g.outgoing(graph, "SCRIPT:D").collect()) == [("execute", "other.dbo.P"), ("read", "other.dbo.P")]
    assert len(g.dependents_of(graph, "other.dbo.p").collect()) == 2
    assert g.get_node(graph, "nobody").count() == 0
    with pytest.raises(ValueError, match="empty"):
        g.incoming(graph, "  ")


def test_source_order_does_not_matter(spark):
    texts = {f"s{i}": f"CREATE VIEW dbo.V{i % 5} AS SELECT * FROM dbo.{'v' if i % 2 else 'V'}{(i * 3) % 7}" for i in range(20)}
    def build(items):
        graph = g.build_graph(parse.parse_sources(sources(spark, **dict(items))))
        return sorted(map(tuple, graph.nodes.collect())), sorted(map(tuple, graph.edges.collect()))
    items = list(texts.items())
    first = build(items)
    random.Random(1).shuffle(items)
    assert build(items) == first


def test_duplicate_and_empty_source_ids(spark):
    with pytest.raises(ValueError, match="duplicate"):
        parse.canonical_sources(sources(spark, a="x", A="y"))
    with pytest.raises(ValueError, match="empty"):
        parse.canonical_sources(files.memory_sources(spark, [(" ./ ", "x", None)]))
    kept = parse.canonical_sources(files.memory_sources(spark, [(" .\\.\\d\\x.sql", "x", None)])).first()
    assert kept["source_id"] == "d/x.sql"


def test_impact_order_and_tree(make):
    graph = make([("ViewA", "Table"), ("ProcB", "ViewA"), ("ProcC", "Table"), ("Table", "ProcB")])
    found = [(r["name"], r["depth"]) for r in closure.impact(graph, " table ").orderBy("ord").collect()]
    assert found == [("Table", 0), ("ProcC", 1), ("ViewA", 1), ("ProcB", 2)]
    paths = sorted(r["path"] for r in closure.impact_paths(graph, "Table").collect())
    assert paths == [["Table"], ["Table", "ProcC"], ["Table", "ViewA"], ["Table", "ViewA", "ProcB"]]
    assert [tuple(r) for r in closure.impact(graph, "Nobody").collect()] == [(0, "Nobody", 0)]
    with pytest.raises(ValueError, match="empty"):
        closure.impact(graph, " ")


def _components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {t for s, t in edges if s == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


def test_strong_components_against_reachability(spark):
    rng = random.Random(1)
    edges = {(f"n{rng.randrange(24):02}", f"n{rng.randrange(24):02}") for _ in range(32)}
    df = spark.createDataFrame(sorted(edges), "src_key string, dst_key string")
    got = {r["node_key"]: r["component"] for r in closure.strong_components(df).collect()}
    assert got == _components(edges)


def test_long_loops_and_tails_take_few_rounds(spark, monkeypatch):
    edges = [(f"r{i:05}", f"r{(i + 1) % 3000:05}") for i in range(3000)]  # a plain loop
    edges += [(f"c{i:05}", f"c{(i + 1) % 2000:05}") for i in range(2000)] + [("c00500", "c01500"), ("c01000", "c00100")]  # a loop with chords
    edges += [(f"t{i:05}", f"t{i + 1:05}") for i in range(2000)] + [("t02000", "c00000"), ("r00007", "t00000")]  # a tail between both
    edges += [("x", f"y{i}") for i in range(1)] + [("y0", "y1"), ("y1", "x"), ("x", "z0"), ("z0", "z1"), ("z1", "x")]  # two loops through one node
    written = []
    real = closure.materialize_counting
    monkeypatch.setattr(closure, "materialize_counting", lambda *a, **k: (written.append(a[1]), real(*a, **k))[1])
    got = {r["node_key"]: r["component"] for r in closure.strong_components(spark.createDataFrame(edges, "src_key string, dst_key string")).collect()}
    want = {f"r{i:05}": "r00000" for i in range(3000)} | {f"c{i:05}": "c00000" for i in range(2000)} | dict.fromkeys(["x", "y0", "y1", "z0", "z1"], "x")
    assert got == want
    assert len(written) < 40


def test_cycles(make):
    found = closure.cycles(make([("A", "B"), ("B", "C"), ("C", "A"), ("A", "C"), ("Z", "Z"), ("Alpha", "Beta", "executes"), ("BETA", "ALPHA"), ("X", "A")]))
    rows = {tuple(m.casefold() for m in r["members"]): (r["is_self_reference"], len(r["edges"])) for r in found.collect()}
    assert rows == {("a", "b", "c"): (False, 4), ("z",): (True, 1), ("alpha", "beta"): (False, 2)}
    assert closure.cycles(make([("A", "B")])).count() == 0


def test_dead_objects(make):
    edges = [("A", "B"), ("B", "A"), ("Caller", "A"), ("C", "D"), ("D", "C"), ("S", "S"), ("dbo.Run", "dbo.Helper")]
    graph = make(edges, {"T": "Trigger", "U": "Unknown", "X": "Script"})
    found = dead.detect(graph, ["DBO.RUN"])
    got = sorted(([m["name"] for m in r["members"]], r["is_circular_component"]) for r in found.findings.collect())
    assert got == [(["C", "D"], True), (["Caller"], False), (["S"], True)]
    assert sorted(tuple(r) for r in found.exclusions.collect()) == [("T", "Trigger", dead.IMPLICIT), ("dbo.Run", "View", dead.DECLARED)]
    assert found.entry_points == ["dbo.Run"]
    with pytest.raises(ValueError, match="not a defined"):
        dead.detect(graph, ["missing"])


def test_impact_of_many_levels(make):
    graph = make([(f"n{i + 1:02}", f"n{i:02}") for i in range(20)] + [("n05", "n19"), ("m", "n03")])
    found = [(r["ord"], r["name"], r["depth"]) for r in closure.impact(graph, "n00").orderBy("ord").collect()]
    assert [o for o, _, _ in found] == list(range(22))
    assert {n: d for _, n, d in found} == {f"n{i:02}": i for i in range(21)} | {"m": 4}


def _corpus(spark):
    return sources(
        spark, z__a="CREATE VIEW dbo.A AS SELECT * FROM dbo.B", b="CREATE VIEW dbo.B AS SELECT * FROM dbo.A", o="CREATE VIEW dbo.Orphan AS SELECT 1 AS x", **{"s__<dyn>": "EXEC (@x)", "empty": ""}
    )


def test_rules_and_repository(spark, tmp_path):
    repo = repository.analyze(_corpus(spark))
    p = report.repository_payload(repo)
    assert len(p) == 12 and p["schema_version"] == "1.0"
    assert [c["members"] for c in p["cycles"]] == [["dbo.A", "dbo.B"]]
    assert [[m["name"] for m in c["members"]] for c in p["dead_object_candidates"]] == [["dbo.A", "dbo.B"], ["dbo.Orphan"]]
    assert p["summary"]["source_count"] == 5 and p["summary"]["finding_count"] == 3 and p["summary"]["error_count"] == 1
    assert p["uncertainty"]["dynamic_sql_objects"] == ["script:s/<dyn>"]
    assert {s["source_id"]: s["objects"] for s in p["sources"]}["empty"] == []
    assert json.loads(report.dump(p)) == p and report.dump(p) == report.dump(report.repository_payload(repo))
    page = report.repository_html(repo, p)
    assert "script:s/&lt;dyn&gt;" in page and "<dyn>" not in page
    assert [r["name"] for r in repo.key_objects(2).collect()] == ["dbo.A", "dbo.B"]
    assert repo.result.has_at_or_above("error") and repo.result.count("WARNING") == 2
    with pytest.raises(ValueError, match="severity"):
        repo.result.count("fatal")
    one = rules.Engine().run(repo.context, ["sql002", "SQL002"])
    assert [r.rule_id for r in one.rules] == ["SQL002"]
    with pytest.raises(ValueError, match="Unknown"):
        rules.Engine().run(repo.context, ["SQL9"])
    with pytest.raises(ValueError, match="Duplicate"):
        rules.Engine([rules.CircularRule(), rules.CircularRule()])
    with pytest.raises(ValueError):
        rules.Engine([])
    payload = report.rules_payload(repo.result)
    assert payload["findings"][0]["properties"] == {"internal_edge_count": 2, "is_self_reference": False}
    assert rules.normal_entry_points([" b ", "A", "B"]) == ["A", "b"]


def test_rings_hold_all_events_of_a_user(spark):
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=-i), 100 * u + i) for u, n in {1: 6, 2: 12, 4: 1, 6: 5}.items() for i in range(n)]
    rings = synthetic.event_rings(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long"))
    assert rings.count() == len(rows)
    objects = parse.parse_sources(rings).cache()
    graph = g.build_graph(objects)
    ring = lambda u, n: sorted(f"dbo.U{u}_{i + 1}" for i in range(n))
    found = closure.cycles(graph.cached())
    assert sorted((r["members"], r["is_self_reference"], len(r["edges"])) for r in found.collect()) == [(ring(2, 12), False, 12), (ring(4, 1), True, 1), (ring(6, 5), False, 5)]
    result = rules.Engine().run(rules.Context(graph.cached(), objects))
    assert sorted((r["rule_id"], r["objects"]) for r in result.findings.collect()) == [
        ("SQL001", ring(2, 12)), ("SQL001", ring(4, 1)), ("SQL001", ring(6, 5)), ("SQL002", ["dbo.U1_1"]), ("SQL002", ring(2, 12)), ("SQL002", ring(4, 1)), ("SQL002", ring(6, 5)),
    ]


def test_impact_json_round_trip():
    text = report.dump({"schema_version": "1.0", "root_object": "a", "impacted_objects": ["a", "b"]})
    assert report.read_impact(text)["impacted_objects"] == ["a", "b"]
    for bad in ("[]", '{"schema_version": "2"}', '{"schema_version": "1.0", "root_object": " "}', '{"schema_version": "1.0", "root_object": "a", "impacted_objects": [1]}'):
        with pytest.raises(ValueError):
            report.read_impact(bad)


def test_token_kinds_and_statements_of_stored_texts(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("./a.sql", "SELECT 'it''s; x' AS [my col]; -- no; token\nGO\nSELECT 2 /* ; */", "tsql", None, at(2)), ("a.sql", "SELECT 1; SELECT 2; SELECT 3", "tsql", None, at(1)),
        ("b.json", '{"a": 1}', "json", None, at(1)), ("c.sql", None, "tsql", None, at(1)), ("d.sql", "SELECT 1;" * 40000, "tsql", None, at(1)),
    ]
    spark.createDataFrame(rows, "source_id string, sql_text string, lang string, path string, committed_at timestamp").write.parquet(f"{tmp_path}/sql_source.parquet")
    kinds = {r["kind"]: r["n"] for r in queries.token_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"identifier": 80012, "symbol": 40003, "operator": 3, "literal": 2}
    assert {r["source_id"]: r["statements"] for r in queries.statement_counts(spark, str(tmp_path)).collect()} == {"a.sql": 2, "b.json": 1, "d.sql": 40000}


def test_lint_and_file_kinds(spark):
    rows = sources(spark, a="select  * from #t; SET nocount ON; exec (@x) CURSOR", b=None)
    got = {(r["source_id"], r["rule"]): r["matches"] for r in parse.lint_counts(rows).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"SELECT_STAR": 1, "NOCOUNT": 1, "CURSOR": 1, "TEMP_TABLE": 1, "DYNAMIC_SQL": 1}
    assert sum(v for k, v in got.items() if k[0] == "b") == 0
    from pyspark.sql import functions as F

    kinds = sources(spark, a="create or  alter procedure p", b="CREATE OR ALTER VIEW v", c="CREATE VIEW v", d="create function f", e=None)
    found = {r["source_id"]: r["k"] for r in kinds.select("source_id", parse.file_kind(F.col("sql_text")).alias("k")).collect()}
    assert found == {"a": "Stored Procedure", "b": "Script", "c": "View", "d": "Function", "e": "Script"}


def test_scan_and_collect(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a+b.sql").write_bytes(b"CREATE VIEW v AS SELECT 1\r\n\xff")
    (tmp_path / "sub dir" / "c%20.sql").write_text("x")
    (tmp_path / "n.txt").write_text("x")
    found = files.scan(spark, str(tmp_path))
    payload = files.scan_payload(str(tmp_path), found)
    assert [f["name"] for f in payload["files"]] == ["a+b.sql", "c%20.sql"] and payload["summary"]["views"] == 1
    assert found.filter("kind = 'View'").first()["content"] == "CREATE VIEW v AS SELECT 1\n"
    assert len(files.collect_files([str(tmp_path)])) == 1 and len(files.collect_files([str(tmp_path)], recursive=True)) == 2
    with pytest.raises(ValueError, match="not a .sql"):
        files.collect_files([str(tmp_path / "n.txt")])
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(tmp_path / "n.txt"))
    (tmp_path / "void").mkdir()
    assert files.scan(spark, str(tmp_path / "void")).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.sql").write_text("CREATE VIEW dbo.A AS SELECT * FROM dbo.B")
    (tmp_path / "b.sql").write_text("CREATE VIEW dbo.B AS SELECT * FROM dbo.A")

    def run(*argv):
        code = cli.main(list(argv))
        return code, capsys.readouterr().out

    assert [n["name"] for n in json.loads(run("dependencies", ".")[1])["nodes"]] == ["dbo.A", "dbo.B"]
    assert len(json.loads(run("cross-references", "a.sql", "b.sql", "--compact")[1])["cross_references"]) == 2
    assert json.loads(run("impact", "DBO.a", ".")[1]) == {"impacted_objects": ["dbo.A", "dbo.B"], "root_object": "dbo.A", "schema_version": "1.0"}
    assert run("impact", "dbo.A", ".", "--html", "out/i.html")[1].strip() == "out/i.html" and "Direct (1)" in (tmp_path / "out/i.html").read_text()
    assert json.loads(run("circular-dependencies", ".")[1])["summary"]["cycle_count"] == 1
    assert json.loads(run("dead-objects", ".", "--entry-point", "dbo.A")[1])["summary"]["excluded_object_count"] == 2
    assert run("analyze", ".", "--rule", "SQL001", "--entry-point", "missing", "--fail-on", "error", "-o", "r.json")[0] == 2
    assert run("analyze", ".", "--rule", "nope")[0] == 1 and run("dependencies", "none.sql")[0] == 1
    code, out = run("repository-analysis", ".", "--html", "r.html", "-o", "r.json")
    assert code == 0 and out.split() == ["r.json", "r.html"]
    assert json.loads(run("parse", "a.sql")[1])["objects"][0]["references"][0]["name"] == "B"
    assert json.loads(run("scan", ".")[1])["summary"]["views"] == 2
    assert json.loads(run("lint", "a.sql")[1])["findings"][0] == {"rule": "SELECT_STAR", "matches": 1}
    assert run()[0] == 0


def test_stream_keeps_the_graph(spark, tmp_path):
    from skein.streaming import ingest

    landing, seen = tmp_path / "in", {}
    for i, text in enumerate(["CREATE VIEW dbo.A AS SELECT * FROM dbo.B", "CREATE TABLE dbo.B (i int)"]):
        files.memory_sources(spark, [(f"s{i}", text, None)]).coalesce(1).write.mode("append").parquet(str(landing))
    stream = ingest.source_stream(spark, str(landing), files_per_batch=1)
    query = ingest.keep_graph(stream, str(tmp_path / "objects"), lambda graph, n: seen.update({n: sorted(r["object_type"] for r in graph.nodes.collect())}), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert seen[max(seen)] == ["Table", "View"]


def test_entry_and_queries_are_registered():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert {"p3_found", "p5_found", "p6_found", "corpus_edges"} <= set(queries)
    assert set(entry.oracle_sql()) <= set(queries)
