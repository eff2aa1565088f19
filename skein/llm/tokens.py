"""Byte-level BPE of whole tables by a pair occurrence index.

A partition's texts are cut into pretokens; every pretoken that was not seen
before in the partition joins one flat symbol sequence. An index holds, for each
adjacent pair that some merge names, all its positions. The ranks in use are
applied in ascending order, each to all its positions at once, and only the
lists of the pairs next to a merge are updated. Texts are then gathered from
the encoded pretokens. No row is dropped: empty and null texts give an empty
list.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How byte-level BPE cuts a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_PRETOKENS = 2_000_000  # of a partition; more than that and the memo starts anew


class Merges:
    """The merge table of a tiktoken-style rank file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, made = [], [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self.width = max(ranks.values()) + 1
        keys = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, dtype=np.int64)[order]
        self.none = np.int64(self.width)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair, which is its rank; ``none`` where no merge joins it."""
        wanted = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.made[at], self.none)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_words(words: list[bytes], table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64), sizes
    sym = table.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    nxt = np.arange(1, total + 1)
    prv = np.arange(-1, total - 1)
    last = np.cumsum(sizes[sizes > 0]) - 1
    nxt[last] = -1
    prv[np.concatenate([[0], last[:-1] + 1])] = -1

    index: dict[int, list[np.ndarray]] = {}  # rank -> positions of its pairs
    waiting: list[int] = []

    def note(positions: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks != table.none
        positions, ranks = positions[keep], ranks[keep]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            r = int(ranks[start])
            if r not in index:
                index[r] = []
                heapq.heappush(waiting, r)
            index[r].append(positions[start:stop])

    at = np.flatnonzero(nxt >= 0)
    note(at, table.rank(sym[at], sym[nxt[at]]))
    while waiting:
        r = heapq.heappop(waiting)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(sym[at] >= 0) & (nxt[at] >= 0)]
        right = nxt[at]
        ok = table.rank(sym[at], sym[right]) == r
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        # Of pairs that overlap, as in "aaa", the leftmost goes first, then every other one.
        touching = np.zeros(len(at), dtype=bool)
        touching[1:] = right[:-1] == at[1:]
        if touching.any():
            runs = np.flatnonzero(~touching)
            place = np.arange(len(at)) - np.repeat(runs, np.diff([*runs, len(at)]))
            at, right = at[place % 2 == 0], right[place % 2 == 0]
        sym[at] = r
        sym[right] = -1
        after = nxt[right]
        nxt[at] = after
        more = after >= 0
        prv[after[more]] = at[more]
        before = prv[at]
        some = before >= 0
        note(before[some], table.rank(sym[before[some]], sym[at[some]]))
        note(at[more], table.rank(sym[at[more]], sym[after[more]]))
    alive = sym >= 0
    return sym[alive], np.bincount(word[alive], minlength=len(words))


class Growing:
    """An array that is added to; its room doubles, so each value is copied a bounded number of times."""

    def __init__(self, dtype):
        self.room, self.used = np.zeros(1024, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.used], np.zeros(max(need, 2 * len(self.room)) - self.used, dtype=self.room.dtype)])
        self.room[self.used : need] = values
        self.used = need


class Encoder:
    """Encodes batch after batch; pretokens met before are not encoded again."""

    def __init__(self, path: str, pattern: str = PRETOKEN):
        import regex

        self.table = merges(path)
        self.find = regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = Growing(np.int32)
        self.starts = Growing(np.int64)
        self.sizes = Growing(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        if len(self.known) > KEPT_PRETOKENS:
            self.reset()
        known, fresh, lengths, places = self.known, [], np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.find(text)
            try:
                row = [known[p] for p in parts]
            except KeyError:
                for p in parts:
                    if p not in known:
                        known[p] = len(known)
                        fresh.append(p)
                row = [known[p] for p in parts]
            lengths[i] = len(row)
            places.append(np.array(row, dtype=np.int32))
        if fresh:
            ids, sizes = encode_words([p.encode("utf-8", "surrogatepass") for p in fresh], self.table)
            begin = self.ids.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.ids.add(ids)
            self.starts.add(begin)
            self.sizes.add(sizes)
        if not places:
            return np.zeros(0, dtype=np.int32), lengths
        at = np.concatenate(places)
        sizes = self.sizes.room[at]
        ends = np.cumsum(sizes)
        out = self.ids.room[np.repeat(self.starts.room[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        owner = np.repeat(np.arange(len(texts)), lengths)
        return out, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)


def _text_slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, count_only: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for whole in batches:
        for batch in _text_slices(whole):
            ids, lengths = encoder.encode(batch.column(0).to_pylist())
            if count_only:
                made, name = pa.array(lengths), "n_tokens"
            else:
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                made, name = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), "ids"
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*batch.schema.names[1:], name])


def encode(df: DataFrame, text: str, keep: list[str], path: str, count_only: bool = False) -> DataFrame:
    """``keep`` columns plus ``ids`` (array of int), or ``n_tokens`` with count_only.

    ``path`` is a rank file (base64 of the bytes, blank, rank). Narrow: nothing
    is shuffled. Special tokens' strings are ordinary text.
    """
    rows = df.select(F.col(text).alias("_text"), *keep)
    schema = T.StructType(list(df.select(*keep).schema.fields)).add(
        *(("n_tokens", T.LongType()) if count_only else ("ids", T.ArrayType(T.IntegerType())))
    )
    return rows.mapInArrow(lambda it: _encode_batches(it, path, count_only), schema)


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The path of a public tokenizer's file; ``folder`` or $SKEIN_TOKENIZERS, else /opt/tokenizers."""
    import os

    return os.path.join(folder or os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers"), name)
