"""Near-duplicate texts by a MinHash LSH forest with exact verification.

Each text is the set of its runs of three words. Every tree of the forest
labels a set with a sequence of LEVELS min-hashes, and the labels of a tree,
sorted over range partitions, are its prefix trie: entries that share a prefix
stand side by side. Prefixes are short enough to meet two sets at the threshold with
the target recall, whatever else the data holds. They are longer only where all
entries together show that this loses nothing: where all that meet below a
short prefix also share a longer one in some tree. Entries whose neighbours
share less than that with them leave; what the others match is verified on the
whole sets.

For groups, neighbours in the sorted tries are verified first, which is linear
in the number of texts; pairs below a prefix are looked at only where they lie
in different groups after that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from skein.operators.hierarchy import connected_components
from skein.operators.orphans import bloom_filter, probe
from skein.runtime import materialize

TREES = 40
LEVELS = 8  # min-hashes of a label, two bytes each
THRESHOLD = 0.7
SHINGLE_WORDS = 3
TARGET_RECALL = 0.9999
BLOCK = 128  # members of a prefix that meet in one step; larger groups meet block by block
SKETCH = 64  # min-hashes that tell whether a pair is worth verifying
DOUBT = 5.0  # deviations below the threshold up to which a sketch counts as near

_WORD = re.compile(r"[a-z0-9_]+")


def recall(similarity: float, length: int, trees: int = TREES) -> float:
    """The chance that two sets share a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def length_for(similarity: float, target: float, longest: int = LEVELS) -> int:
    """The longest prefix that meets the target recall at a similarity."""
    return next((n for n in range(longest, 1, -1) if recall(similarity, n) >= target), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word runs as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        parts = _WORD.findall(text.lower())
        if len(parts) < self.words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        try:
            row = np.array([known[w] for w in parts], dtype=np.uint64)
        except KeyError:
            for w in set(parts).difference(known):
                known[w] = xxh64_intdigest(w)
            row = np.array([known[w] for w in parts], dtype=np.uint64)
        out = np.zeros(len(parts) - self.words + 1, dtype=np.uint64)
        for i in range(self.words):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + row[i : len(parts) - self.words + 1 + i])
        return np.unique(out)


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, at, rep, labels): rep is the digest of the set, labels those of all trees, one after another; null for texts without a set."""
    shingler = Shingler(words)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**31, size=TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, size=TREES * LEVELS, dtype=np.uint32)
    for batch in batches:
        reps: list[bytes | None] = []
        labels: list[bytes | None] = []
        for text in batch.column(2).to_pylist():
            s = shingler.hashes(text) if text else ()
            if not len(s):
                reps.append(None)
                labels.append(None)
                continue
            # The hashes are well mixed already; odd multiples modulo 2**32 reorder them.
            half = (s >> np.uint64(32)).astype(np.uint32)
            low = np.full(TREES * LEVELS, np.iinfo(np.uint32).max, dtype=np.uint32)
            for start in range(0, len(half), 256):
                low = np.minimum(low, (half[start : start + 256, None] * a + b).min(axis=0))
            reps.append(_digest(s))
            labels.append(((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes())
        if reps:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reps, type=pa.binary()), pa.array(labels, type=pa.binary())], names=["id", "at", "rep", "labels"])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(words)
    for batch in batches:
        sets = [s for s in (shingler.hashes(t) for t in batch.column(0).to_pylist() if t) if len(s)]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], type=pa.binary()), _lists([s.view(np.int64) for s in sets])], names=["digest", "shingles"])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))


def _trie(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """(tree, label, rep, near, shared, before) of sorted entries: near is the longest prefix shared with a neighbour,
    before the entry in front and shared the prefix shared with it.

    An entry at either end of the partition may match beyond it: its near is LEVELS. Entries whose near is less than
    shortest are left out.
    """
    held = None  # the last entry, whose next neighbour is not known yet

    def out(tree, label, rep, near, shared, before) -> pa.RecordBatch:
        cols = [pa.array(tree, type=pa.int32()), pa.array([x.tobytes() for x in label], type=pa.binary()), pa.array(rep), pa.array(near, type=pa.int32()), pa.array(shared, type=pa.int32()), pa.array(before)]
        return pa.RecordBatch.from_arrays(cols, names=["tree", "label", "rep", "near", "shared", "before"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree = batch.column(0).to_numpy(zero_copy_only=False)
        label = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(n, LEVELS)
        rep = batch.column(2).to_numpy(zero_copy_only=False)
        shared = np.full(n, LEVELS, dtype=np.int32)
        before = rep.copy()  # the first entry of a partition has none: itself
        if held is not None:
            tree, label, rep = np.concatenate([held[0], tree]), np.concatenate([held[1], label]), np.concatenate([held[2], rep])
            shared, before = np.concatenate([held[3], shared]), np.concatenate([held[4], before])
        m = len(tree)
        if m > 1:
            same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            shared[1:] = np.cumprod(same, axis=1).sum(axis=1)
            before[1:] = rep[:-1]
        near = np.maximum(shared, np.concatenate([shared[1:], [0]]))
        if m > 1:
            keep = near[:-1] >= shortest
            yield out(*(c[:-1][keep] for c in (tree, label, rep, near, shared, before)))
        held = tree[-1:], label[-1:], rep[-1:], shared[-1:], before[-1:]
    if held is not None:
        yield out(held[0], held[1], held[2], [LEVELS], held[3], held[4])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, prefix, lo, hi) of rows that come sorted by prefix: one row for each, the least and the greatest min-hash at every place of its labels."""
    held = None  # the last prefix, which may go on in the next batch

    def out(at, lo, hi) -> pa.RecordBatch:
        cols = [pa.array([t for t, _ in at], type=pa.int32()), pa.array([p for _, p in at], type=pa.binary()), *(pa.array([x.tobytes() for x in c], type=pa.binary()) for c in (lo, hi))]
        return pa.RecordBatch.from_arrays(cols, names=["tree", "prefix", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        lo, hi = _min_hashes(batch, 2), _min_hashes(batch, 3)
        if held is not None:
            at, lo, hi = held[0] + at, np.concatenate([held[1], lo]), np.concatenate([held[2], hi])
        starts = [i for i in range(len(at)) if not i or at[i] != at[i - 1]]
        at, lo, hi = [at[i] for i in starts], np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
        if len(at) > 1:
            yield out(at[:-1], lo[:-1], hi[:-1])
        held = at[-1:], lo[-1:], hi[-1:]
    if held is not None:
        yield out(*held)


def _shared_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest prefix that all labels between lo and hi share in some tree."""
    for batch in batches:
        if batch.num_rows:
            same = (_min_hashes(batch, 2) == _min_hashes(batch, 3)).reshape(batch.num_rows, TREES, LEVELS)
            yield pa.RecordBatch.from_arrays([pa.array(np.cumprod(same, axis=2).sum(axis=2).max(axis=1), type=pa.int32())], names=["length"])


def _min_hashes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)


def _block_pairs(batches: Iterator[pa.RecordBatch], least_equal: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the entries of each (prefix, i, j) whose sketches are near; rows come sorted by those.

    Entries of one block meet one another where i = j, else only those of the other block; those of one group never.
    """
    at, kept = None, []

    def meet() -> tuple[np.ndarray, np.ndarray]:
        block, rep, group = (np.array([r[c] for r in kept], dtype=np.int64) for c in (0, 1, 3))
        sketch = np.frombuffer(b"".join(r[2] for r in kept), dtype=np.uint16).reshape(len(kept), SKETCH)
        left, right = [], []
        for k in range(len(kept) - 1):
            near = (sketch[k + 1 :] == sketch[k]).sum(axis=1) >= least_equal
            near &= rep[k + 1 :] != rep[k]
            near &= (group[k + 1 :] != group[k]) | (group[k] < 0)
            if at[1] != at[2]:
                near &= block[k + 1 :] != block[k]
            hit = np.flatnonzero(near) + k + 1
            left.append(np.minimum(rep[hit], rep[k]))
            right.append(np.maximum(rep[hit], rep[k]))
        return np.concatenate(left), np.concatenate(right)

    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for *key, block, rep, sketch, group in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if key != at:
                if len(kept) > 1:
                    found.append(meet())
                    held += len(found[-1][0])
                at, kept = key, []
            kept.append((block, rep, sketch, group))
        if held > 50_000:
            yield flush()
            found, held = [], 0
    if len(kept) > 1:
        found.append(meet())
    if found:
        yield flush()


@dataclass
class Forest:
    """The signed texts: members (id, digest), different sets (rep, digest, least, labels), the sorted tries, and the prefix length."""

    texts: DataFrame
    members: DataFrame
    sets: DataFrame
    tries: DataFrame
    length: int
    threshold: float
    words: int

    def matching(self) -> DataFrame:
        """(tree, prefix, rep) of the entries that share a prefix of the length found with a neighbour."""
        return self.tries.filter(F.col("near") >= self.length).select("tree", _prefix(self.length), "rep")


def _prefix(length: int) -> Column:
    return F.substring(F.col("label"), 1, 2 * length).alias("prefix")


def build_forest(
    texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, target: float = TARGET_RECALL, latest: str | None = None
) -> Forest:
    """Sign the texts, sort the tries and find the prefix length.

    Null texts and texts with fewer words than a shingle are left out. Texts
    with equal sets share one rep, so copies cost nothing further. Where a key
    has several rows, the one with the greatest ``latest`` counts (a missing one
    is the least, ties go to the greatest rep); without ``latest`` keys are
    unique. Texts are never shuffled: they are signed where they lie.
    """
    at = F.col(latest).cast("timestamp") if latest else F.lit(None).cast("timestamp")
    rows = texts.select(F.col(key).cast("string").alias("id"), at.alias("at"), F.col(text).alias("t")).filter("id is not null")
    schema = "id string, at timestamp, rep binary, labels binary"
    every = rows.mapInArrow(lambda it: _signatures(it, words), schema)
    if latest:
        order = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp")), "rep")
        every = every.groupBy("id").agg(F.max_by(F.struct("rep", "labels"), order).alias("s")).select("id", "s.rep", "s.labels")
    signed = materialize(every.filter("rep is not null").select("id", F.col("rep").alias("digest"), "labels"), "signed")
    # Different sets are numbered: eight bytes instead of a digest in all that follows.
    different = signed.groupBy("digest").agg(F.min_by("labels", "id").alias("labels"), F.min("id").alias("least"))
    sets = materialize(different.withColumn("rep", F.monotonically_increasing_id()), "different")
    entries = sets.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels", "rep")
    entries = entries.select("tree", F.col("labels").substr(F.col("tree") * (2 * LEVELS) + 1, F.lit(2 * LEVELS)).alias("label"), "rep")
    tries = entries.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    shortest = length_for(threshold, target)  # meets the target for all pairs that count
    tries = materialize(tries.mapInArrow(lambda it: _trie(it, shortest), "tree int, label binary, rep long, near int, shared int, before long"), "tries")
    forest = Forest(rows, signed.select("id", "digest"), sets, tries, shortest, threshold, words)
    forest.length = _lossless_length(forest)
    return forest


def _lossless_length(forest: Forest) -> int:
    """The longest length such that all that stand below one prefix of the present length share a prefix of it in some tree.

    So no two entries that match at the present length are lost. Taken from all
    entries. It is no longer than what each set shares with any neighbour; that
    mostly settles it. Else the members of a prefix are folded, not paired, and
    where they lie first, so no prefix fills a task.
    """
    bound = forest.tries.groupBy("rep").agg(F.max("near").alias("near")).agg(F.min("near")).first()[0]  # one number
    if bound is None or bound <= forest.length:
        return LEVELS if bound is None else forest.length
    labels = forest.sets.select("rep", F.col("labels").alias("lo"), F.col("labels").alias("hi"))
    spans = forest.matching().join(labels, "rep").select("tree", "prefix", "lo", "hi")
    schema = "tree int, prefix binary, lo binary, hi binary"
    spans = spans.sortWithinPartitions("tree", "prefix").mapInArrow(_spans, schema)
    spans = spans.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix").mapInArrow(_spans, schema)
    return spans.mapInArrow(_shared_lengths, "length int").agg(F.min("length")).first()[0]  # one number


def _candidates(forest: Forest, group: DataFrame | None = None) -> DataFrame:
    """(a, b) of sets that share a prefix and whose sketches are near; with ``group`` (rep, g), of different groups only.

    Groups below a prefix are cut into blocks by hash; each two blocks meet in a
    step of their own, so no prefix fills a task.
    """
    rows = forest.matching()
    if group is not None:
        rows = rows.join(group, "rep")
    else:
        rows = rows.withColumn("g", F.lit(-1).cast("long"))
    sizes = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    several = sizes.filter("n > 1" if group is None else "n > 1 and lo <> hi").select("tree", "prefix", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    rows = rows.join(several, ["tree", "prefix"]).join(forest.sets.select("rep", F.substring("labels", 1, 2 * SKETCH).alias("sketch")), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "sketch", "g")
    key = F.concat(F.lpad(F.col("tree").cast("string"), 3, "0").cast("binary"), F.col("prefix")).alias("key")
    placed = rows.select(key, "i", "j", "block", "rep", "sketch", "g").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    t = forest.threshold
    least_equal = max(0, int(SKETCH * t - DOUBT * (SKETCH * t * (1 - t)) ** 0.5))
    return placed.mapInArrow(lambda it: _block_pairs(it, least_equal), "a long, b long").distinct()


def _verify(forest: Forest, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold, on their whole sets.

    Only the texts that a Bloom filter of the pairs' members lets through are read again.
    """
    pairs = materialize(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = materialize(wanted.join(forest.sets.select("rep", "digest", "least"), "rep"), "wanted")
    bloom, buckets = bloom_filter(wanted, "least")
    again = probe(forest.texts, "id", bloom, buckets).filter("may_exist").select("t")
    words = forest.words
    shingled = again.mapInArrow(lambda it: _sets(it, words), T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))
    sets = materialize(shingled.join(wanted.select("digest", "rep"), "digest").groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    similar = shared.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
    return materialize(similar.filter(F.col("similarity") >= forest.threshold), "near-pairs")


def similar_sets(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, target: float = TARGET_RECALL, latest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of different shingle sets, and which text has which set.

    Returns (a, b, similarity), a < b, over set ids, and members (id, rep); see
    build_forest for the texts that count. All pairs are the result here, so a
    cluster of n near texts gives its n(n-1)/2 rows; ``groups`` does not.
    """
    forest = build_forest(texts, key, text, threshold, words, target, latest)
    return _verify(forest, _candidates(forest)), forest.members.join(forest.sets.select("digest", "rep"), "digest").select("id", "rep")


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of texts, those with equal sets included."""
    one, two = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = pairs.join(one, "a").join(two, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    repeated = members.join(copies, "rep")
    within = (
        repeated.select("rep", F.col("id").alias("id_a")).join(repeated.select("rep", F.col("id").alias("id_b")), "rep").filter("id_a < id_b").select("id_a", "id_b")
    )
    return between.unionByName(within)


def groups(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, target: float = TARGET_RECALL, latest: str | None = None) -> DataFrame:
    """(id, group_id): one row for each text that has a set; group_id is the least id of its connected group.

    Neighbours in the sorted tries that share a prefix are verified first, at
    most TREES links for each set. Pairs below a prefix are looked at only where
    their members are still in different groups, so a cluster of near texts
    costs a number of links in proportion to its size.
    """
    forest = build_forest(texts, key, text, threshold, words, target, latest)
    beside = forest.tries.filter((F.col("shared") >= forest.length) & (F.col("rep") != F.col("before")))
    chained = _verify(forest, beside.select(F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b")).distinct())
    first = _components(forest, chained.select("a", "b"))
    across = _verify(forest, _candidates(forest, first.withColumnRenamed("component", "g")))
    last = _components(forest, chained.select("a", "b").unionByName(across.select("a", "b")))
    per = materialize(forest.sets.select("rep", "digest", "least").join(last, "rep"), "classes")
    name = per.groupBy("component").agg(F.min("least").alias("group_id"))
    return forest.members.join(per, "digest").join(name, "component").select("id", "group_id")


def _components(forest: Forest, links: DataFrame) -> DataFrame:
    """(rep, component) of every set."""
    linked = connected_components(links).select(F.col("node").alias("rep"), "component")
    return materialize(forest.sets.select("rep").join(linked, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "groups")
