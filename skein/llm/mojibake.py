"""Text that was decoded with the wrong character encoding: found and restored.

All words of the corpus are counted. Every distinct word is put through all
chains of one right and one wrong encoding, and through all pairs of wrong
encodings one after the other; a Bloom filter of the words that occur drops the
forms that nobody holds where they are made, and the others are hash-joined with
the words that occur. A word that occurs and is the garbled form of another word
is garbled; documents are joined with this table, and the originals are put back
in place. Where a chain can be run both ways, the word that is less oddly written
is the original, then the one that more different texts hold; copies of a text
weigh nothing beside that.

ASCII words pass through 8-bit encodings unharmed; of them only the forms that
arise from taking two bytes for one UTF-16 unit, or one unit for two bytes, are
made.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skein.runtime import materialize, materialize_counting, spread

# Encodings in which texts are written, and as which they are misread.
WRITTEN = "cp1252 cp1250 cp1251 cp1253 cp1258 latin-1 iso8859_2 iso8859_5 iso8859_7 koi8_r cp437 cp850 cp852 cp866 cp737 mac_roman mac_latin2 mac_cyrillic mac_greek shift_jis euc_jp gbk big5 euc_kr".split()  # noqa: SIM905
MISREAD = "cp1252 latin-1 cp437 cp850 cp852 mac_roman mac_latin2 cp1250 cp1251 cp1253 koi8_r cp866 iso8859_2 iso8859_5 iso8859_7 mac_cyrillic".split()  # noqa: SIM905
MISREAD_WIDE = "gbk shift_jis big5 euc_kr euc_jp".split()  # noqa: SIM905

_WORD = re.compile(r"[A-Za-z0-9_\x80-\U0010ffff]+")
_ASCII_WORD = re.compile(r"[A-Za-z]{5,}")
_CORE = re.compile(r"(?:(?<=[a-z])(?=[^\W\d_a-zA-Z])|[A-Z]?[a-z]*)[^\x00-\x7f][a-z\x80-\U0010ffff]*")
LONG = 1000  # characters; longer words and forms are joined by their digests
WHOLE, CORE, TAIL, UNITS = 0, 1, 2, 3  # kinds of words: whole, part of a name, from its first foreign letter, UTF-16 pairs


@lru_cache(maxsize=64)
def _table(codec: str) -> tuple[str, bool]:
    """The 256 characters of an 8-bit encoding; bytes it leaves open stay control characters."""
    out, gaps = [], False
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
            gaps = True
    return "".join(out), gaps


def _misread(data: bytes, codec: str) -> list[str]:
    """How bytes look in an 8-bit encoding, by each way of treating bytes it leaves open; these left as they are come first."""
    table, gaps = _table(codec)
    text = data.decode("latin-1").translate(table)
    if not gaps:
        return [text]
    return list(dict.fromkeys([text, data.decode(codec, "ignore"), data.decode(codec, "replace")]))


@lru_cache(maxsize=32)
def _letters(codec: str) -> frozenset[str] | None:
    """All characters of an 8-bit encoding; None for a wider one."""
    return None if codec in MISREAD_WIDE else frozenset(bytes(range(256)).decode(codec, "ignore"))


def _encoded(words: list[str], codec: str) -> list[tuple[int, bytes]]:
    """(place, bytes) of the words that an encoding can write."""
    letters = _letters(codec)
    out = []
    for i, word in enumerate(words):
        if letters is None or letters.issuperset(word):
            try:
                out.append((i, word.encode(codec)))
            except UnicodeEncodeError:
                continue
    return out


def garbled_forms(words: list[str]) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Lists of (place of the word, form), one for each chain; one_way chains lead to no originals.

    Chains: UTF-8 read as any of MISREAD or MISREAD_WIDE; UTF-8 read as any of
    MISREAD, written as UTF-8 and read as any of MISREAD again; any of WRITTEN
    read as UTF-8, MISREAD or MISREAD_WIDE. 8-bit readings go over all words at
    once, with a line break between words, which no word holds.
    """
    places = range(len(words))
    joined = "\n".join(words).encode("utf-8", "surrogatepass")
    for codec in MISREAD:
        for once in _misread(joined, codec):
            yield list(zip(places, once.split("\n"), strict=True)), True
            again = once.encode("utf-8", "surrogatepass")
            for second in MISREAD:
                for twice in _misread(again, second):
                    yield list(zip(places, twice.split("\n"), strict=True)), True
    for codec in MISREAD_WIDE:
        for errors in ("replace", "ignore"):
            yield [(i, w.encode("utf-8", "surrogatepass").decode(codec, errors)) for i, w in zip(places, words, strict=True)], True
    for written in WRITTEN:
        able = _encoded(words, written)
        if not able:
            continue
        lost = [(i, d.decode("utf-8", "replace")) for i, d in able]
        yield [(i, f) for i, f in lost if "\ufffd" in f], True  # else it would be the undoing of a misreading
        spots, data = [i for i, _ in able], b"\n".join(d for _, d in able)
        for codec in MISREAD:
            for form in _misread(data, codec):
                yield list(zip(spots, form.split("\n"), strict=True)), False
        for codec in MISREAD_WIDE:
            for errors in ("replace", "ignore"):
                yield [(i, d.decode(codec, errors)) for i, d in able], False


_JOINS = frozenset("'\u2019\u2018\u00b7_0123456789")  # what stands between the letters of a word


def oddness(word: str) -> int:
    """How many places of a word are unusual in writing: a capital after a small letter that starts no new part of a
    name, letters of two scripts side by side, punctuation or symbols between letters, control characters."""
    odd = sum(unicodedata.category(c) == "Cc" for c in word)
    for a, b, c in zip(word, word[1:], word[2:] + " ", strict=False):
        if a.isalpha() and b.isalpha():
            odd += (a.islower() and b.isupper() and not c.islower()) or _script(a) != _script(b)
        elif a.isalpha() and c.isalpha() and b not in _JOINS:
            odd += unicodedata.category(b)[0] in "PS" and unicodedata.category(b) != "Pd"
    return odd


@lru_cache(maxsize=4096)
def _script(letter: str) -> str:
    """The script in a letter's name; the scripts of East Asian texts, which stand side by side, count as one."""
    name = unicodedata.name(letter, "").partition(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "HANGUL", "KATAKANA-HIRAGANA") else name


def unit_forms(word: str) -> Iterator[str]:
    """An ASCII word's letters read two by two as UTF-16 units, for both places to start; or its units as bytes."""
    for start in (0, 1):
        data = word[start : start + (len(word) - start) // 2 * 2].encode("ascii")
        if len(data) >= 4:
            yield data.decode("utf-16-le")
            yield data.decode("utf-16-be")
    for codec in ("utf-16-le", "utf-16-be"):
        yield word.encode(codec).decode("latin-1")


_LETTER_PAIRS = re.compile("(?:[" + "".join(f"{chr(h * 256 + 0x41)}-{chr(h * 256 + 0x5A)}{chr(h * 256 + 0x61)}-{chr(h * 256 + 0x7A)}" for h in [*range(0x41, 0x5B), *range(0x61, 0x7B)]) + "]){2,}")


_SPLIT_UNITS = re.compile(r"(?:[A-Za-z]\x00){5,}|(?:\x00[A-Za-z]){5,}")


def plain(text: str) -> bool:
    """Whether no word of a text can be garbled."""
    return text.isascii() and "\0" not in text


def words_of(text: str) -> Iterator[tuple[int, str]]:
    """The words of a text that hold foreign letters or zero bytes, by kind."""
    if "\0" in text:
        for units in _SPLIT_UNITS.findall(text):
            yield UNITS, units
    for token in _WORD.findall(text):
        if token.isascii():
            continue
        yield WHOLE, token
        core = _CORE.search(token)
        if core and core.group() != token:
            yield CORE, core.group()
        first = next(i for i, c in enumerate(token) if c > "\x7f")
        tail = re.match(r"[a-z\x80-\U0010ffff]+", token[first:]).group()
        if tail != token and len(tail) > 2:
            yield TAIL, tail
        for pairs in _LETTER_PAIRS.findall(token) if len(token) > 8 else ():
            yield UNITS, pairs


def _iter(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            yield part, part.column(part.schema.names.index("text")).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word, text, n): the words of each text with its digest; ASCII words, of kind -1, only counted by batch."""
    for _, texts in _iter(batches):
        plain_words: Counter = Counter()
        rows: Counter = Counter()
        for text in texts:
            if not plain(text):
                digest = xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                rows.update({(kind, word, digest) for kind, word in words_of(text)})
            plain_words.update(set(_ASCII_WORD.findall(text)))
        out = [(*key, n) for key, n in rows.items()] + [(-1, w, 0, n) for w, n in plain_words.items()]
        if out:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "word", "text", "n"])


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _iter(batches):
        rows = [(i, k, w) for i, text in enumerate(texts) if not plain(text) for k, w in set(words_of(text))]
        if rows:
            at, kinds, words = zip(*rows, strict=True)
            at = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(kinds, type=pa.int32()), pa.array(words, type=pa.string())],
                names=["table_name", "record_key", "kind", "word"],
            )


def _key(word: str) -> str:
    """What a word or form is joined by; no word holds a zero byte alone at its start."""
    return word if len(word) <= LONG else "\0" + hashlib.sha256(word.encode("utf-8")).hexdigest()


def _key_column(name: str) -> Column:
    """:func:`_key` of a column."""
    return F.when(F.char_length(name) > LONG, F.concat(F.lit("\0"), F.sha2(F.col(name).cast("binary"), 256))).otherwise(F.col(name))


FILTER_BYTES = 8 << 20  # the largest filter of words that is sent to the workers; beyond it all forms are joined


class Present:
    """A Bloom filter of join keys with two probes, as bytes; without bytes it lets everything through."""

    def __init__(self, bits: bytes | None):
        self.bits = bits
        self.size = 8 * len(bits or b"")

    def may_hold(self, kind: int, form: str) -> bool:
        if self.bits is None:
            return True
        h = xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 42 + kind)
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in (h % self.size, (h >> 20) % self.size))


def _mark(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The places of the filter's bits that a partition's keys set."""
    for batch in batches:
        at: set[int] = set()
        for kind, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 42 + kind)
            at.update((h % size, (h >> 20) % size))
        yield pa.RecordBatch.from_arrays([pa.array(list(at), type=pa.int64())], names=["at"])


def _present(words: DataFrame, n: int) -> Present:
    """The filter of ``words`` (kind, form): 16 bits for each, as bitmaps that Spark puts together; None beyond FILTER_BYTES."""
    maps = -(-n * 16 // 32768) or 1
    if maps * 4096 > FILTER_BYTES:
        return Present(None)
    size = maps * 32768
    marked = words.mapInArrow(lambda it: _mark(it, size), "at long").groupBy(F.floor(F.col("at") / 32768).alias("k")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    out = bytearray(maps * 4096)
    for row in marked.collect():  # at most FILTER_BYTES
        out[row["k"] * 4096 : (row["k"] + 1) * 4096] = row["bits"]
    return Present(bytes(out))


_BETWEEN = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]")  # what no word holds


def _forms(batches: Iterator[pa.RecordBatch], present: Present) -> Iterator[pa.RecordBatch]:
    may_hold = present.may_hold

    def made(out: set[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            names = ["kind", "form", "original", "n", "one_way"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            out: set[tuple] = set()
            rows = []
            for kind, word, n in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == -1:
                    out.update((UNITS, _key(f), _key(word), n, True) for f in unit_forms(word) if may_hold(UNITS, _key(f)))
                else:
                    rows.append((kind, word, _key(word), n))
            words = [r[1] for r in rows]
            for chain, one_way in garbled_forms(words) if words else ():
                for i, form in chain:
                    kind, word, original, n = rows[i]
                    if form == word or form.isascii():
                        continue
                    if kind == WHOLE:
                        if not _BETWEEN.search(form):
                            if may_hold(kind, key := _key(form)):
                                out.add((kind, key, original, n, one_way))
                        else:
                            pieces = (_key(p) for p in _WORD.findall(form) if len(p) > 3 and not p.isascii())
                            out.update((kind, p, None, n, one_way) for p in pieces if may_hold(kind, p))
                    elif (kind == CORE or (one_way and sum(c > "\x7f" for c in form) > 1)) and may_hold(kind, key := _key(form)):
                        out.add((kind, key, original, n, one_way))
            yield from made(out)


def _worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word, worth): how likely a word is an original, compared in order: less oddly written, in more different texts, more letters, fewer capitals."""
    for batch in batches:
        worth = [[-oddness(w), n, sum(map(str.isalpha, w)), -sum(map(str.isupper, w))] for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(worth, type=pa.list_(pa.int64()))], names=["kind", "word", "worth"])


def garbled_words(texts: DataFrame) -> DataFrame:
    """(kind, word, original): the words that are garbled, with the word they stand for, of several the most frequent.

    original is null where the word is a piece of a garbled form that was cut by
    ASCII characters. ``texts``: table_name, record_key, text.
    """
    each = texts.mapInArrow(_count, "kind int, word string, text long, n long")
    once = each.groupBy("kind", "word", "text").agg(F.sum("n").alias("copies"))
    once = once.groupBy("kind", "word").agg(F.sum(F.when(F.col("kind") == -1, F.col("copies")).otherwise(1)).alias("n"))
    words, seen = materialize_counting(once, "words", foreign=F.count_if(F.col("kind") >= 0))
    held = words.filter("kind >= 0").select("kind", _key_column("word").alias("form"))
    present = _present(held, seen["foreign"] or 0)
    forms = spread(words).mapInArrow(lambda it: _forms(it, present), "kind int, form string, original string, n long, one_way boolean").distinct()
    # Written once: chains that lead one way and those that lead both are told apart below.
    hit = materialize(forms.join(held.distinct(), ["kind", "form"]).filter("original is null or original <> form"), "forms")
    # Two 8-bit encodings can be taken for each other both ways: then the better word is the original.
    worth = materialize(words.filter("kind >= 0").mapInArrow(_worth, "kind int, word string, worth array<long>"), "worth")
    of = lambda name: worth.select("kind", _key_column("word").alias(name), F.col("worth").alias(f"worth_{name}"))
    told = hit.filter("not one_way").join(of("form"), ["kind", "form"]).join(of("original"), ["kind", "original"]).filter("worth_original > worth_form")
    hit = hit.filter("one_way").select("kind", "form", "original", "n").unionByName(told.select("kind", "form", "original", "n"))
    found = hit.groupBy("kind", "form").agg(F.max_by("original", F.struct(F.col("original").isNotNull(), "n", "original")).alias("original"))
    long = words.filter(F.char_length("word") > LONG)
    of_form = long.select("kind", _key_column("word").alias("form"), F.col("word").alias("long_word"))
    # ASCII words, of kind -1, are originals of UTF-16 pairs.
    of_original = long.select(F.when(F.col("kind") == -1, UNITS).otherwise(F.col("kind")).alias("kind"), _key_column("word").alias("original"), F.col("word").alias("long_original")).distinct()
    found = found.join(of_form, ["kind", "form"], "left").join(of_original, ["kind", "original"], "left")
    return found.select("kind", F.coalesce("long_word", "form").alias("word"), F.coalesce("long_original", "original").alias("original"))


def find_garbled(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that hold garbled characters, and all their garbled words.

    Returns (table_name, record_key), and (table_name, record_key, kind, word,
    original). Replacement characters mark a text as garbled whether or not
    their originals are known. Null and empty texts are never garbled.
    """
    texts = materialize(texts.filter("text is not null and text <> ''").select("table_name", "record_key", "text"), "texts")
    table = materialize(garbled_words(texts), "garbled")
    held = texts.filter(F.col("text").rlike(r"[^\x01-\x7F]")).mapInArrow(_doc_words, "table_name string, record_key string, kind int, word string")
    words = materialize(held.join(table, ["kind", "word"]).select("table_name", "record_key", "kind", "word", "original"), "garbled-in")
    lost = texts.filter(F.contains("text", F.lit("�"))).select("table_name", "record_key")
    found = words.select("table_name", "record_key").unionByName(lost).distinct()
    return found, words


def _put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, keys, texts, words = (batch.column(i).to_pylist() for i in range(4))
        restored, complete, replaced = [], [], []
        for text, pairs in zip(texts, words, strict=True):
            whole = {p["word"]: p["original"] for p in pairs or () if p["kind"] == WHOLE and p["original"]}
            parts = {p["word"]: p["original"] for p in pairs or () if p["kind"] in (CORE, TAIL) and p["original"]}
            count, left = 0, False

            def fix(m: re.Match, whole=whole, parts=parts) -> str:
                nonlocal count, left
                token = m.group()
                if token.isascii():
                    return token
                if token in whole:
                    count += 1
                    return whole[token]
                for part in sorted(parts, key=len, reverse=True):
                    if part in token:
                        count += 1
                        return token.replace(part, parts[part])
                left |= "�" in token
                return token

            if any(p["kind"] == UNITS for p in pairs or ()):
                restored.append(_undo_units(text, {p["original"] for p in pairs if p["kind"] == UNITS and p["original"]}))
                count, left = count + 1, restored[-1] is None
                restored[-1] = restored[-1] or text
            else:
                restored.append(_WORD.sub(fix, text))
            replaced.append(count)
            complete.append(not left and count > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(keys), pa.array(restored), pa.array(replaced, type=pa.int64()), pa.array(complete)],
            names=["table_name", "record_key", "restored", "n_replaced", "complete"],
        )


def _undo_units(text: str, originals: set[str]) -> str | None:
    """A text whose UTF-16 units were split or joined, put right: the reading that holds the originals found."""
    # A zero byte that was cut off at the end is put back.
    ways = [(text + "\0" * (len(text) % 2), "latin-1", c) for c in ("utf-16-le", "utf-16-be")] if "\0" in text else [(text, c, "utf-8") for c in ("utf-16-le", "utf-16-be")]
    best, most = None, 0
    for padded, written, read in ways:
        try:
            out = padded.encode(written).decode(read)
        except UnicodeError:
            continue
        held = sum(o in out for o in originals)
        if held > most:
            best, most = out, held
    return best


def restore(texts: DataFrame) -> DataFrame:
    """Every garbled text with its originals put back.

    Columns table_name, record_key, restored, n_replaced, complete; complete is
    false where replacement characters are left or nothing could be put back.
    """
    found, words = find_garbled(texts)
    per = words.groupBy("table_name", "record_key").agg(F.collect_set(F.struct("kind", "word", "original")).alias("words"))
    rows = found.join(per, ["table_name", "record_key"], "left").join(texts, ["table_name", "record_key"])
    return rows.select("table_name", "record_key", "text", "words").mapInArrow(
        _put_back, "table_name string, record_key string, restored string, n_replaced long, complete boolean"
    )
