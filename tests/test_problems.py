"""The core problems against plain loops, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import chunked, hierarchy, orphans
from skein.plans import problems

EDGE = "edge_id long, source string, target string, kind string, repository string, seen_at timestamp, ingested_at timestamp"
NODE = "node_id long, node_key string, name string, object_type string, registered_at timestamp, ingested_at timestamp"
RECORD = "object_id long, name string, dependents array<string>, defined_at timestamp, removed_at timestamp, ingested_at timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def edge(i, s, t, kind="executes", at=0, repo="r"):
    return (i, s, t, kind, repo, None if at is None else day(at), day(0))


# ------------------------------------------------------------- chunked work
def test_number_rows_positions_sums_and_previous(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(50), rng.randrange(-3, 9), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o int, v int, id long").repartition(7)
    out = chunked.number_rows(df, "k", ["o", "id"], sums=["v"], previous=["id"], partitions=6).collect()
    assert len(out) == 3000
    by = {}
    for k, o, v, i in sorted(data, key=lambda r: (r[0], r[1], r[3])):
        seen = by.setdefault(k, [])
        seen.append((i, v))
    for r in out:
        rows = by[r["k"]]
        at = r["_pos"]
        assert rows[at][0] == r["id"]
        assert r["_run_v"] == sum(v for _, v in rows[: at + 1])
        assert r["_prev_id"] == (rows[at - 1][0] if at else None)


def test_number_rows_with_nulls_ties_and_reserved_names(spark):
    df = spark.createDataFrame([("a", None, None, 1), ("a", None, 2, 1), (None, 1, 5, 1), ("a", None, 2, 1)], "k string, o int, v int, _pos int")
    out = chunked.number_rows(df, "k", ["o"], sums=["v"])
    assert sorted(out.columns) == ["_pos", "_run_v", "k", "o", "v"]
    assert sorted(r["_pos"] for r in out.collect()) == [0, 1, 2]
    assert max(r["_run_v"] for r in out.collect()) == 4
    assert chunked.number_rows(df.limit(0), "k", ["o"], sums=["v"], previous=["o"]).count() == 0


def test_edge_target_stats(spark):
    data = [edge(1, "a", " T ", at=0), edge(2, "a", "t\t", "references", at=5), edge(3, "a", "T", at=None), edge(4, "b", None), edge(5, "b", "  "), edge(6, "b", "u", at=2), edge(6, "b", "u", at=2)]
    df = spark.createDataFrame(data, EDGE).withColumnRenamed("repository", "_pid")
    out = {r["name_key"]: r for r in chunked.edge_target_stats(df, chunk_rows=2).collect()}
    assert set(out) == {"t", "u"}
    assert (out["t"]["n_rows"], out["t"]["n_executes"], out["t"]["longest_gap_s"]) == (3, 2, 5 * 86400.0)
    assert (out["t"]["first_seen"], out["t"]["last_seen"]) == (day(0), day(5))
    assert (out["u"]["n_rows"], out["u"]["longest_gap_s"]) == (2, 0.0)
    assert chunked.heavy_keys(chunked.edge_target_stats(df.limit(0)), "n_rows", 0.015).count() == 0


def test_dependent_stats_latest_delivery_counts(spark):
    data = [
        (1, "X", ["a"], day(0), None, day(1)),
        (1, "x ", ["A", "b", "B", None, ""], day(0), None, day(2)),
        (2, "y", None, day(0), None, day(1)),
        (3, "y", [], day(0), None, day(1)),
        (4, None, ["q"], day(0), None, day(1)),
        (5, "X", ["a", "c"], day(0), None, day(1)),
    ]
    out = {r["name_key"]: (r["n_entries"], r["n_dependents"]) for r in chunked.dependent_stats(spark.createDataFrame(data, RECORD)).collect()}
    assert out == {"x": (7, 3)}


def test_offsets_count_every_partition(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]),) for _ in range(900)]
    df = spark.createDataFrame(data, "k string").repartition(5)
    rows = chunked.key_offsets(df, "k").collect()
    want = Counter(k for (k,) in data if k)
    for k, n in want.items():
        own = sorted((r["part"], r["n"], r["before"]) for r in rows if r["k"] == k)
        assert [b for _, _, b in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == n
    chunks = chunked.count_chunks(chunked.key_offsets(df, "k"), "k", 7).collect()
    for k, n in want.items():
        assert sorted((r["chunk"], r["rows"]) for r in chunks if r["k"] == k) == [(c, min(7, n - 7 * c)) for c in range(-(-n // 7))]
    assert {r["k"]: r["n_rows"] for r in chunked.key_totals(df, "k", 7).collect()} == dict(want)
    assert chunked.key_totals(df.limit(0), "k").count() == 0


# ------------------------------------------------------------------ orphans
def _system(spark):
    return spark.createDataFrame([("Sys.Tables", "System"), (None, None)], "name string, object_type string")


def test_orphans_against_loops(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)] + ["hot"]
    records, edges, nodes = [], [], []
    for i in range(60):
        start = rng.randrange(100)
        end = None if rng.random() < 0.3 else day(start + rng.randrange(0, 20))
        records.append((i, rng.choice(names).upper() + " ", None, day(start), end, day(start)))
        if rng.random() < 0.3:
            records.append((i, "other", None, day(0), None, day(0) - dt.timedelta(days=1)))
    for i in range(800):
        t = "hot" if rng.random() < 0.5 else rng.choice([*names, "gone", None, " ", "SYS.tables"])
        edges.append(edge(i, "s", t, at=rng.randrange(120)))
    edges += edges[:40]
    for i in range(100):
        nodes.append((i, "k", rng.choice([*names, "gone"]), rng.choice(["Table", " unknown", "", None, "VIEW"]), day(rng.randrange(120)), None))
    nodes.append((999, "k", "gone", "Table", None, None))
    latest = {r[0]: r for r in sorted(records, key=lambda r: (r[0], r[5]))}
    lives = [(r[1].strip().lower(), r[3], r[4]) for r in latest.values()]
    alive = lambda k, t: any(n == k and a <= t and (b is None or t < b) for n, a, b in lives)
    want = {("dependency_edge", e[0]) for e in edges if e[2] and e[2].strip() and e[2].lower() != "sys.tables" and not alive(e[2].lower(), e[5])}
    want |= {("dependency_node", n[0]) for n in nodes if n[3] in ("Table", "VIEW") and n[4] and not alive(n[2], n[4])}
    args = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), spark.createDataFrame(records, RECORD), _system(spark)
    out = orphans.find_orphans(*args)
    assert {(r["table_name"], r["record_id"]) for r in out.collect()} == want
    assert out.count() == len(want)
    assert {r["filter_proved"] for r in out.collect()} == {True, False}
    rates = orphans.orphan_rates(out, orphans.references(args[0], args[1], args[3]))
    assert sum(r["orphans"] for r in rates.collect()) == len(want)


def test_orphans_of_empty_tables(spark):
    edges, nodes, records = spark.createDataFrame([edge(1, "s", "t")], EDGE), spark.createDataFrame([], NODE), spark.createDataFrame([], RECORD)
    assert orphans.find_orphans(edges, nodes, records, _system(spark)).count() == 1
    assert orphans.find_orphans(edges.limit(0), nodes, records, _system(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives_and_a_bound(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as k")
    bloom, buckets = orphans.bloom_filter(keys, "k")
    assert orphans.probe(keys, "k", bloom, buckets).filter("not may_exist").count() == 0
    others = spark.range(5000).selectExpr("concat('x', id) as k")
    assert orphans.probe(others, "k", bloom, buckets).filter("may_exist").count() < 250
    assert bloom.count() <= buckets == -(-keys.agg({"k": "approx_count_distinct"}).first()[0] * 16 // orphans.BITS)
    joined = orphans.probe(keys.union(others).withColumn("salt", F.lit(1)), "k", bloom, buckets, max_bitmaps=0)
    assert joined.columns == ["k", "may_exist"] and joined.count() == 10000
    assert joined.filter("not may_exist and k like 'k%'").count() == 0 and joined.filter("may_exist and k like 'x%'").count() < 250


# ---------------------------------------------------------------- hierarchy
def _walk(parent):
    """(root, depth, in_cycle) of each node by following parents one at a time."""
    out = {}
    for n in set(parent) | set(parent.values()):
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at not in parent:
            out[n] = (at, len(seen), 0)
        else:
            loop = seen[seen.index(at) :]
            out[n] = (min(loop), 0, 1) if n in loop else (min(loop), seen.index(at), 0)
    return out


def test_hierarchy_against_loops(spark):
    rng = random.Random(5)
    parent = {}
    for i in range(1, 400):
        parent[f"t{i:03}"] = f"t{rng.randrange(max(0, i - 6), i):03}"
    for i in range(1, 120):
        parent[f"chain{i:03}"] = f"chain{i - 1:03}"
    for a, b in [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("self", "self"), ("h1", "l2"), ("h2", "h1"), ("h3", "self"), *((f"h{i + 1}", f"h{i}") for i in range(3, 40))]:
        parent[a] = b
    for i in range(200):
        parent[f"leaf{i}"] = "t000"
    data = [edge(i, p.upper() + " ", "\t" + c, repo=None if i % 3 == 0 else f"r{i % 4}") for i, (c, p) in enumerate(parent.items())]
    data += data[:50] + [edge(9000, "lonely", None), edge(9001, "ignored", "t001", "references")]
    rng.shuffle(data)
    links = hierarchy.executes_links(spark.createDataFrame(data, EDGE).repartition(5))
    found = hierarchy.resolve_hierarchy(links)
    out = {r["node_key"]: (r["root_key"], r["depth"], r["in_cycle"]) for r in found.collect()}
    want = _walk(parent) | {"lonely": ("lonely", 0, 0)}
    assert out == want and found.count() == len(want)
    paths = {r["node_key"]: r["path"] for r in hierarchy.paths(links, found).collect()}
    assert set(paths) == set(want)
    assert paths["chain119"] == [f"chain{i:03}" for i in range(120)]
    assert all(len(p) == want[n][1] + 1 and p[-1] == n for n, p in paths.items())
    below = Counter(r["ancestor"] for r in hierarchy.descendants(hierarchy.paths(links, found)).collect())
    assert below["chain000"] == 119


def test_descendants_of_every_name_on_a_loop(spark, tmp_path):
    parent = {"b": "a", "c": "b", "d": "c", "a": "d", "x": "c", "y": "x", "z": "a", "self": "self", "s1": "self", "t1": "t0", "t2": "t1", "q": "p", "p": "q"}
    want = set()
    for n in parent:
        at, steps, seen = parent[n], 1, {n}
        while at is not None and at not in seen:
            want.add((at, n, steps))
            seen.add(at)
            at, steps = parent.get(at), steps + 1
    data = [edge(i, p, c) for i, (c, p) in enumerate(parent.items())]
    spark.createDataFrame(data, EDGE).write.parquet(f"{tmp_path}/dependency_edge.parquet")
    out = [tuple(r) for r in problems.p6_descendants(spark, str(tmp_path)).select("ancestor", "descendant", "steps").collect()]
    assert set(out) == want and len(out) == len(want)
    assert {("b", "a", 3), ("a", "b", 1), ("d", "y", 5)} <= want


def test_hierarchy_of_nothing_and_of_one_loop(spark):
    empty = spark.createDataFrame([], EDGE)
    assert hierarchy.resolve_hierarchy(hierarchy.executes_links(empty)).count() == 0
    one = spark.createDataFrame([edge(1, "a", "b"), edge(2, "b", "a")], EDGE)
    out = hierarchy.resolve_hierarchy(hierarchy.executes_links(one))
    assert {(r["node_key"], r["root_key"], r["depth"], r["in_cycle"]) for r in out.collect()} == {("a", "a", 0, 1), ("b", "a", 0, 1)}


def test_a_child_of_two_parents_keeps_the_least(spark):
    two = spark.createDataFrame([edge(1, "p2", "c"), edge(2, "p1", "c")], EDGE)
    out = {r["node_key"]: r["root_key"] for r in hierarchy.resolve_hierarchy(hierarchy.executes_links(two)).collect()}
    assert out == {"c": "p1", "p1": "p1", "p2": "p2"}


def test_connected_components(spark, rows):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = rows(hierarchy.connected_components(spark.createDataFrame(pairs, "a string, b string")))
    assert got == sorted((n, find(n)) for n in list(top))


@pytest.mark.parametrize("name", ["_n", "bits"])
def test_extra_columns_do_not_matter(spark, name):
    from pyspark.sql import functions as F

    edges = spark.createDataFrame([edge(1, "s", "t")], EDGE).withColumn(name, F.lit(1))
    records = spark.createDataFrame([(1, "T", ["s"], day(0), None, day(0))], RECORD).withColumn(name, F.lit(1))
    assert orphans.find_orphans(edges, spark.createDataFrame([], NODE), records, _system(spark)).count() == 0
    assert chunked.edge_target_stats(edges).count() == 1
    assert hierarchy.resolve_hierarchy(hierarchy.executes_links(edges)).count() == 2
