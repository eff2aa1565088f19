"""One form for text that looks the same but consists of different characters.

Arrow text is decoded once a batch into a numpy array of code points. A lookup
table gives every code point its expansion (none for invisible ones, the base
form for width and kind variants, the parts of an accented letter, the Latin
letter for one of the same shape); expansions are gathered by offsets. Marks are
then put in canonical order and composed with their letters by table, again over
the whole batch at once.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.runtime import materialize

LIMIT = 0x110000

# Letters of other scripts that have the shape of a Latin letter of the same case: Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu, phonetic.
SAME_SHAPE = {
    "АВЕЅІӀЈКМНОРСТУХҮҺԌԚԜѴ": "ABESIIJKMHOPCTYXYhGQWV",
    "асеіӏјорѕухһԁԛԝүѵ": "aceiljopsyxhdqwyv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "αινορυϲϳ": "aivopucj",
    "ՍՏՕԼ": "USOL",
    "հոսօցզ": "hnuogq",
    "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ": "BHIKMNOPCTYX",
    "ⲟⲣⲥ": "opc",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHYGZRWSVSLCPKB",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    "ɑɡ": "ag",
}
# Code points without a visible form, as inclusive ranges.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
#: Kinds of compatibility forms that look like what they stand for.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _base_form(ch: str) -> str:
    """What one character looks like, fully decomposed."""
    code = ord(ch)
    if any(a <= code <= b for a, b in INVISIBLE):
        return ""
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if not parts and not 0xAC00 <= code <= 0xD7A3:
        return ch
    if parts and parts[0][0] == "<":
        same = parts[0] in SAME_LOOK or (
            parts[0] == "<compat>" and (kind in ("Lu", "Ll", "Lt", "Lo", "Nl") or 0x2E80 <= code <= 0x2FDF)
        )
        if not same:
            return ch
        return "".join(_base_form(chr(int(p, 16))) for p in parts[1:])
    if 0xAC00 <= code <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    return "".join(_base_form(chr(int(p, 16))) for p in parts)


class Tables:
    """The lookup tables, built from the Unicode database in one pass."""

    def __init__(self) -> None:
        shape = {ord(a): b for one, two in SAME_SHAPE.items() for a, b in zip(one, two, strict=True)}
        self.size = np.ones(LIMIT, dtype=np.uint8)
        self.start = np.arange(LIMIT, dtype=np.int32)
        pool = np.arange(LIMIT, dtype=np.uint32)
        extra: list[int] = []
        changed = np.zeros(LIMIT, dtype=bool)
        self.rank = np.zeros(LIMIT, dtype=np.uint8)
        pairs: dict[tuple[int, int], int] = {}
        for code in range(0x80, 0x30000):
            if 0xD800 <= code <= 0xDFFF:
                continue
            ch = chr(code)
            self.rank[code] = unicodedata.combining(ch)
            base = "".join(shape.get(ord(c), c) for c in _base_form(ch))
            if base != ch:
                changed[code] = True
                self.size[code], self.start[code] = len(base), LIMIT + len(extra)
                extra += map(ord, base)
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<" and len(p := parts.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(p[0], 16), int(p[1], 16)] = code
        for a, b in INVISIBLE:
            changed[a : b + 1], self.size[a : b + 1] = True, 0
        # A pair of a look-alike letter composes as that of its Latin letter does.
        self.pool = np.concatenate([pool, np.array(extra, dtype=np.uint32)])
        self.changed = changed
        keys = np.array([a * LIMIT + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_codes = np.array(list(pairs.values()), dtype=np.uint32)[order]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code point of each pair, 0 where there is none."""
        wanted = a.astype(np.int64) * LIMIT + b
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        made = np.where(self.pair_keys[at] == wanted, self.pair_codes[at], 0).astype(np.int64)
        lead, vowel = a.astype(np.int64) - 0x1100, b.astype(np.int64) - 0x1161
        made = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), 0xAC00 + (lead * 21 + vowel) * 28, made)
        syllable, tail = a.astype(np.int64) - 0xAC00, b.astype(np.int64) - 0x11A7
        return np.where((syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28), a + tail, made)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def unify(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common form of code points, and the row each belongs to."""
    t = tables()
    size = t.size[codes].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = t.pool[np.repeat(t.start[codes] - (ends - size), size) + np.arange(total)]
    row = np.repeat(row, size)
    rank = t.rank[out]
    marks = np.flatnonzero(rank)
    if len(marks):
        # Runs of marks go in canonical order; a run never leaves its text.
        fresh = np.ones(len(marks), dtype=bool)
        fresh[1:] = (np.diff(marks) != 1) | (row[marks[1:]] != row[marks[:-1]])
        order = np.lexsort((marks, rank[marks], np.cumsum(fresh)))
        out[marks] = out[marks[order]]
        rank[marks] = rank[marks[order]]
    conjoining = (out >= 0x1161) & (out < 0x1200)
    follower = (rank > 0) | conjoining
    while True:
        # Each round joins the first follower of every base with it, where a composed form exists.
        at = np.flatnonzero(follower)
        if not len(at):
            break
        base = np.where(follower, -1, np.arange(len(out)))
        base = np.maximum.accumulate(base)[at]
        ok = base >= 0
        ok &= np.where(ok, row[np.maximum(base, 0)] == row[at], False)
        # Blocked: a mark of the same rank, or for ranks 0 anything, stands in between.
        before = at - 1
        ok &= (before == base) | ((rank[before] > 0) & (rank[before] < rank[at]))
        made = np.zeros(len(at), dtype=np.int64)
        made[ok] = t.pair(out[base[ok]], out[at[ok]])
        hit = np.flatnonzero(made)
        if not len(hit):
            break
        hit = hit[np.unique(base[hit], return_index=True)[1]]
        out[base[hit]] = made[hit]
        keep = np.ones(len(out), dtype=bool)
        keep[at[hit]] = False
        out, row, rank, follower = out[keep], row[keep], rank[keep], follower[keep]
    return out, row


def unify_texts(texts: pa.Array) -> pa.Array:
    """The common form of every text of an Arrow array; nulls stay null."""
    n = len(texts)
    joined, row = _code_points(texts)
    out, row = unify(joined, row)
    ends = np.cumsum(np.bincount(row, minlength=n)) if n else np.zeros(0, dtype=np.int64)
    data = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    at_byte = np.concatenate([[0], np.cumsum(width)])
    offsets = np.concatenate([[0], at_byte[ends]]).astype(np.int64)
    valid = None
    if texts.null_count:
        valid = pa.array(np.asarray(texts.is_valid())).buffers()[1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data), valid, texts.null_count)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the row of each, from the array's buffers."""
    big = texts.cast(pa.large_string())
    n = len(big)
    _, offsets, data = big.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[big.offset : big.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    lengths = np.diff(heads[offsets - offsets[0]])
    return codes, np.repeat(np.arange(n), lengths)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            texts = batch.column(0)
            same = unify_texts(texts)
            raw_bytes, forms = texts.cast(pa.large_binary()).to_pylist(), same.cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in c], type=pa.binary()) for c in (forms, raw_bytes))],
                names=[*batch.schema.names[1:], "form", "exact"],
            )


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], unify_texts(batch.column(0)).cast(pa.string())], names=[*batch.schema.names[1:], "unified"])


def unified(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``unified``, the text in its common form; null stays null, empty empty."""
    schema = T.StructType(list(df.select(*keep).schema.fields)).add("unified", T.StringType())
    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(_forms, schema)


def digests(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus 128-bit digests of the common form and of the text itself.

    Null and empty texts give no row.
    """
    schema = T.StructType(list(df.select(*keep).schema.fields)).add("form", T.BinaryType()).add("exact", T.BinaryType())
    rows = df.filter((F.col(text).isNotNull()) & (F.col(text) != "")).select(F.col(text).alias("_text"), *keep)
    return rows.mapInArrow(_digests, schema)


def _mixed(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, form, exact) of the texts whose form stands for several different texts.

    Forms of one text only, however often it is repeated, leave after a
    pre-aggregated count, so only real look-alikes are joined.
    """
    rows = materialize(digests(df, text, [key]), "digests")
    mixed = rows.groupBy("form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select("form")
    return materialize(rows.join(mixed, "form").select(key, "form", "exact"), "lookalikes")


def lookalike_pairs(df: DataFrame, text: str, key: str) -> DataFrame:
    """(a, b), a < b: keys of texts that look the same but differ in characters.

    Different texts of a form are paired first, one row for each text however
    many copies it has; both sides are then given their copies. So what is
    joined is in proportion to the result, and copies of one text never meet.
    """
    rows = _mixed(df, text, key)
    texts = rows.select("form", "exact").distinct()
    both = texts.withColumnRenamed("exact", "x").join(texts.withColumnRenamed("exact", "y"), "form").filter("x < y")
    of = lambda side, name: rows.select("form", F.col("exact").alias(side), F.col(key).alias(name))
    pairs = both.join(of("x", "one"), ["form", "x"]).join(of("y", "two"), ["form", "y"])
    return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))


def lookalike_classes(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, class_key, n_texts, n_members): one row for each text that looks like a different one.

    class_key is the least key of its form, n_texts the different texts of the
    form and n_members all of its rows, copies included.
    """
    rows = _mixed(df, text, key)
    per = rows.groupBy("form", "exact").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    per = per.groupBy("form").agg(F.min("least").alias("class_key"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_members"))
    return rows.join(per, "form").select(key, "class_key", "n_texts", "n_members")
