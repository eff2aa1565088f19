"""Parent-child links of unknown depth to roots, depths, paths and loops.

Links are first contracted inside each partition by a weighted disjoint-set
forest: every child points at the top of its partition-local tree with its
offset from it. What crosses partitions is then merged by joins in which each
pointer takes on the pointer of what it points at and adds the offset, so the
rounds grow with the logarithm of the number of crossings. Merging forests two
by two down to one task would gather all links there; the joins keep every
round spread. Loops that lie whole in a partition are told there; pointers that
no round can end lie on loops across partitions or below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.names import name_key
from skein.runtime import materialize, materialize_counting, release


def executes_links(edges: DataFrame) -> DataFrame:
    """(child, parent, place) of the executes rows: name keys, place the repository.

    A null or blank target gives a row with child null, so its source still counts.
    Repeated links give one row.
    """
    rows = edges.filter(F.lower(F.trim("kind")) == "executes").select(
        name_key("target").alias("child"), name_key("source").alias("parent"), "repository"
    )
    return rows.groupBy("child", "parent").agg(F.min("repository").alias("place")).filter("child is not null or parent is not null")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted disjoint-set forest of one partition's links: (node, anc, steps, loop_key).

    Each node keeps (top, offset). Path compression runs over all nodes at once:
    a node whose top has a link takes over that node's top and adds its offset,
    until nothing moves. Nodes that never settle lie on or below loops that are
    whole in the partition: a loop's nodes get its least name as loop_key and no
    pointer, those below point at the node of the loop that they meet.
    """
    pdf = pd.concat(list(batches), ignore_index=True)
    if pdf.empty:
        return
    codes, names = pd.factorize(pd.concat([pdf["node"], pdf["anc"]], ignore_index=True), sort=True)
    n = len(pdf)
    child, parent = codes[:n], codes[n:]
    linked = np.zeros(len(names), dtype=bool)
    linked[child] = True
    rounds = int(np.ceil(np.log2(n + 1))) + 1

    def settle() -> tuple[np.ndarray, np.ndarray]:
        top = np.arange(len(names))
        top[child] = parent
        top[~linked] = np.flatnonzero(~linked)
        offset = linked.astype(np.int64)
        for _ in range(rounds):
            moving = linked[top]
            if not moving.any():
                break
            offset, top = np.where(moving, offset + offset[top], offset), np.where(moving, top[top], top)
        return top, offset

    top, offset = settle()
    loop = np.full(len(names), -1)
    ring = np.unique(top[linked & linked[top]])  # after so many steps up, only nodes on loops are left
    if len(ring):
        at = np.arange(len(names))
        at[child] = parent
        low = np.arange(len(names))  # names are in order, so codes compare as they do
        for _ in range(rounds):
            low[ring], at[ring] = np.minimum(low[ring], low[at[ring]]), at[at[ring]]
        loop[ring] = low[ring]
        linked[ring] = False
        top, offset = settle()
    on = loop[child] >= 0
    found = np.asarray(names, dtype=object)
    pdf["anc"] = np.where(on, None, found[top[child]])
    pdf["steps"] = offset[child]
    pdf["loop_key"] = np.where(on, found[loop[child]], None)
    yield pdf[["node", "anc", "steps", "loop_key"]]


def _resolve(links: DataFrame, local: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All (node, anc, steps) whose anc has no link or lies on a loop of one partition; the nodes of those
    loops (node, loop_key); and the links left over on or below loops that cross partitions.

    ``links``: materialized (node, anc, place), one row for a node.
    """
    if local:
        # Trees mostly stay within a repository; the node splits large ones.
        placed = links.repartitionByRange("place", "node").select("node", "anc")
        contracted = materialize(placed.mapInPandas(_contract, "node string, anc string, steps long, loop_key string"), "pointers")
        pointers = contracted.filter("anc is not null").select("node", "anc", "steps")
        rings = contracted.filter("loop_key is not null").select("node", "loop_key")
    else:
        pointers = materialize(links.select("node", "anc", F.lit(1).cast("long").alias("steps")), "pointers")
        rings = links.select("node", F.col("anc").alias("loop_key")).limit(0)
    as_far = lambda d: d.select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("steps").alias("more"))
    ended: list[DataFrame] = []
    left = None
    while True:
        other = as_far(pointers)
        for done in ended:
            other = other.unionByName(as_far(done))
        step = pointers.join(other, "anc", "left").select(
            "node", F.coalesce("far", "anc").alias("anc"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNull().alias("ended")
        )
        step, n = materialize_counting(step, "pointers", left=F.count_if(~F.col("ended")))
        if left is not None:
            release(pointers)
        ended.append(step.filter("ended").drop("ended"))
        if n["left"] == 0 or n["left"] == left:
            break
        left, pointers = n["left"], step.filter("not ended").drop("ended")
    resolved = ended[0]
    for done in ended[1:]:
        resolved = resolved.unionByName(done)
    if n["left"] == 0:
        return resolved, rings, None
    return resolved, rings, step.filter("not ended").select("node").join(links.select("node", "anc"), "node")


def _loops(links: DataFrame) -> DataFrame:
    """(node, loop_key) of the nodes on loops; ``links`` holds only nodes on or below loops.

    Doubling: after k rounds a node points 2^k steps up. The set pointed at
    shrinks every round until only loop nodes are left; the least name seen on
    the way settles once it is the least of the whole loop.
    """
    low = F.least("node", "anc").alias("low")
    up = lambda d: d.select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("low").alias("far_low"))
    state, images = materialize(links.select("node", "anc", low), "loops"), None
    while True:
        n = state.agg(F.count_distinct("anc")).first()[0]
        if n == images:
            break
        images = n
        step = materialize(state.join(up(state), "anc").select("node", F.col("far").alias("anc"), F.least("low", "far_low").alias("low")), "loops")
        release(state)
        state = step
    on = state.select(F.col("anc").alias("node")).distinct()
    ring, moved = materialize(links.join(on, "node").select("node", "anc", low), "ring"), 1
    while moved:
        step = ring.join(up(ring), "anc").select("node", F.col("far").alias("anc"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved"))
        step, n = materialize_counting(step, "ring", moved=F.count_if("moved"))
        release(ring)
        ring, moved = step.drop("moved"), n["moved"]
    return ring.select("node", F.col("low").alias("loop_key"))


def resolve_hierarchy(links: DataFrame) -> DataFrame:
    """(node_key, root_key, depth, in_cycle) of every name in (child, parent, place).

    A child with several parents keeps the least parent, so the result stays
    defined. Loop nodes have in_cycle 1, depth 0 and the least name of the loop
    as root; nodes below a loop count their steps from it. Empty input, empty
    result.
    """
    links = materialize(links, "links")
    own = materialize(
        links.filter("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min(F.struct("parent", "place")).alias("l")).select("node", F.col("l.parent").alias("anc"), F.col("l.place").alias("place")),
        "own-links",
    )
    resolved, rings, stuck = _resolve(own, local=True)
    everyone = links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).filter("node is not null").distinct()
    tops = everyone.join(own.select("node"), "node", "left_anti").select("node", F.col("node").alias("anc"), F.lit(0).cast("long").alias("steps"))
    zero = F.lit(0).cast("long")
    if stuck is not None:
        stuck = materialize(stuck, "stuck")
        across = _loops(stuck)
        below = stuck.join(across.select("node"), "node", "left_anti").withColumn("place", F.lit(None).cast("string"))
        hanging, _, _ = _resolve(materialize(below, "below"), local=False)
        resolved, rings = resolved.unionByName(hanging), rings.unionByName(across)
    loop_of = rings.select(F.col("node").alias("anc"), "loop_key")
    pointed = resolved.join(loop_of, "anc", "left").select("node", F.coalesce("loop_key", "anc").alias("anc"), "steps")
    return (
        pointed.unionByName(tops)
        .select(F.col("node").alias("node_key"), F.col("anc").alias("root_key"), F.col("steps").alias("depth"), zero.alias("in_cycle"))
        .unionByName(rings.select(F.col("node").alias("node_key"), F.col("loop_key").alias("root_key"), zero.alias("depth"), F.lit(1).cast("long").alias("in_cycle")))
    )


def paths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Each node's full path from its root (or from the loop it hangs on), top first.

    ``roots`` is what resolve_hierarchy gave. The links, indexed by child, are
    traversed by doubling: a segment up to some ancestor is joined with that
    ancestor's own segment, so the rounds grow with the logarithm of the depth.
    The loop node a path starts from is kept as its first name. Columns
    node_key, path.
    """
    own = links.filter("child is not null and parent is not null").groupBy(F.col("child").alias("node_key")).agg(F.min("parent").alias("anc"))
    tops = roots.filter("depth = 0").select("node_key", F.array("node_key").alias("path"))
    done = materialize(tops, "paths")
    inner = roots.filter("depth > 0").select("node_key").join(own, "node_key")
    active, n = materialize_counting(inner.select("node_key", "anc", F.array("node_key").alias("path")), "paths", n=F.count(F.lit(1)))
    parts = [done]
    while n["n"]:
        ready = parts[0]
        for part in parts[1:]:
            ready = ready.unionByName(part)
        above = ready.select(F.col("node_key").alias("anc"), F.lit(None).cast("string").alias("far"), F.col("path").alias("upper")).unionByName(
            active.select(F.col("node_key").alias("anc"), F.col("anc").alias("far"), F.col("path").alias("upper"))
        )
        step = active.join(above, "anc").select("node_key", F.col("far").alias("anc"), F.concat("upper", "path").alias("path"))
        step, n = materialize_counting(step, "paths", n=F.count_if(F.col("anc").isNotNull()))
        parts.append(step.filter("anc is null").select("node_key", "path"))
        active = step.filter("anc is not null")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def loop_pairs(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, steps) of two different names on one loop.

    Each loop is opened at its least name; the places of its names from there
    give the steps between any two. ``roots`` is what resolve_hierarchy gave.
    """
    ring = materialize(roots.filter("in_cycle = 1").select(F.col("node_key").alias("node"), F.col("root_key").alias("loop_key")), "ring")
    own = links.filter("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("anc"))
    opened = own.join(ring.filter("node <> loop_key").select("node"), "node").withColumn("place", F.lit(None).cast("string"))
    placed, _, _ = _resolve(materialize(opened, "opened"), local=True)
    at = placed.select("node", F.col("anc").alias("loop_key"), "steps").unionByName(ring.filter("node = loop_key").withColumn("steps", F.lit(0).cast("long")))
    at = materialize(at, "places")
    size = at.groupBy("loop_key").agg(F.count(F.lit(1)).alias("size"))
    upper = at.select("loop_key", F.col("node").alias("ancestor"), F.col("steps").alias("up"))
    pairs = at.withColumnRenamed("node", "descendant").join(size, "loop_key").join(upper, "loop_key").filter("ancestor <> descendant")
    return pairs.select("ancestor", "descendant", F.pmod(F.col("steps") - F.col("up"), F.col("size")).alias("steps"))


def descendants(node_paths: DataFrame, on_loops: DataFrame | None = None) -> DataFrame:
    """Every (ancestor, descendant, steps) with steps > 0, the least where a loop gives several.

    Read off the paths. A path holds but one name of the loop it hangs on; the
    others come from ``on_loops``, which loop_pairs gave, and are missing without.
    A name on a loop is not listed as its own descendant.
    """
    out = node_paths.select(
        F.posexplode("path").alias("i", "ancestor"), F.col("node_key").alias("descendant"), (F.size("path") - 1 - F.col("i")).cast("long").alias("steps")
    ).filter("steps > 0").select("ancestor", "descendant", "steps")
    if on_loops is None:
        return out
    tops = node_paths.select(F.element_at("path", 1).alias("top"), F.col("node_key").alias("below"), (F.size("path") - 1).cast("long").alias("more"))
    through = on_loops.join(tops, F.col("descendant") == F.col("top"))
    return out.unionByName(through.select("ancestor", F.col("below").alias("descendant"), (F.col("steps") + F.col("more")).alias("steps")))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): component is the least node.

    Alternating star steps: every node links its larger, then its smaller
    neighbours to the least of them, until nothing changes. Rounds grow with the
    logarithm of the component's size, no component is gathered in one task.
    """
    low_first = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(low_first(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), "stars")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        mid = low_first(large)
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        joined = mid.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        step = materialize(low_first(small), "stars")
        stat = tuple(step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(edges)
        edges = step
        if stat == last:
            break
        last = stat
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(tops)
