"""Operators for training data against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import datetime as dt
import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("skein.llm")

from pyspark.sql import functions as F  # noqa: E402

from skein.llm import corpus, lookalike, mixing, mojibake, neardup, tokens, validity  # noqa: E402
from skein.llm.derivative import Grammar  # noqa: E402
from skein.llm.grammars import examine  # noqa: E402


# ------------------------------------------------------------ 1 near-duplicates
def _shingles(text):
    words = [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789_" else " " for c in text.lower()).split()]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def _near(texts):
    sets = {k: _shingles(t) for k, t in texts.items() if t}
    keys = sorted(k for k, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"w{rng.randrange(3000)}"]
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(8)
    texts = {}
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(90)]
        for member in range(12):
            texts[f"f{family:02}-{member:02}"] = _edited(rng, base, rng.randrange(14))
    texts |= {"copy1": texts["f00-00"], "copy2": texts["f00-00"].upper() + " !", "null": None, "empty": "", "two": "a b", "two2": "a b", "three": "a b c", "three2": "A-b.c", "long": "x y z " * 30000}
    return texts


@pytest.mark.parametrize("block", [128, 3])
def test_similar_sets_finds_every_pair(spark, near_texts, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = spark.createDataFrame(list(near_texts.items()), "id string, text string").withColumn("rep", F.lit(1)).withColumn("labels", F.lit(2))
    pairs, members = neardup.similar_sets(df, "id", "text")
    got = {(r["id_a"], r["id_b"]) for r in neardup.member_pairs(pairs, members).collect()}
    assert got == _near(near_texts)


def test_groups_hold_every_near_text_once(spark, near_texts):
    df = spark.createDataFrame(list(near_texts.items()), "id string, text string")
    rows = neardup.groups(df, "id", "text").collect()
    group = {r["id"]: r["group_id"] for r in rows}
    assert len(rows) == len(group) and set(group) == {k for k, t in near_texts.items() if t and _shingles(t)}
    top = {k: k for k in group}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in _near(near_texts):
        a, b = sorted((find(a), find(b)))
        top[b] = a
    assert group == {k: find(k) for k in group}


def test_prefixes_are_as_long_as_what_matches_allows(spark, near_texts):
    df = spark.createDataFrame(list(near_texts.items()), "id string, text string")
    short = neardup.build_forest(df, "id", "text")
    assert short.length == neardup.length_for(0.7, neardup.TARGET_RECALL) == 4
    rng = random.Random(1)
    copies = [(f"{f}-{m}", " ".join([*(f"w{f}x{i}" for i in range(300)), f"v{m}"])) for f in range(8) for m in range(4)]
    rng.shuffle(copies)
    long = neardup.build_forest(spark.createDataFrame(copies, "id string, text string"), "id", "text")
    assert long.length == neardup.LEVELS and neardup.recall(0.9, long.length) > neardup.TARGET_RECALL


def test_few_pairs_at_the_threshold_among_many_copies(spark):
    rng = random.Random(3)
    texts = {}
    for f in range(600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts[f"c{f:04}a"], texts[f"c{f:04}b"] = " ".join(base), " ".join([*base, "end"])
    for f in range(12):  # 74 of 102 runs are shared
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        texts[f"d{f:04}a"], texts[f"d{f:04}b"] = " ".join(base), " ".join([*base[:76], *(f"x{f}y{i}" for i in range(14))])
    pairs, members = neardup.similar_sets(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text")
    got = {(r["id_a"], r["id_b"]) for r in neardup.member_pairs(pairs, members).collect()}
    assert got == {(f"{k}a", f"{k}b") for k in {key[:-1] for key in texts}} == _near(texts)


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_longer_prefixes_lose_no_match(spark, edits):
    rng = random.Random(edits)
    texts = []
    for f in range(5):
        base = [f"w{f}x{i}" for i in range(100)]
        texts += [(f"{f}-{m}", " ".join([_edited(rng, base, edits), f"v{m}"])) for m in range(5)]
    forest = neardup.build_forest(spark.createDataFrame(texts, "id string, text string").repartition(3), "id", "text")
    labels = [[r["labels"][i : i + 2 * neardup.LEVELS] for i in range(0, len(r["labels"]), 2 * neardup.LEVELS)] for r in forest.sets.collect()]

    def met(length):
        cut = [[label[: 2 * length] for label in row] for row in labels]
        return {(i, j) for i, one in enumerate(cut) for j in range(i) if any(map(bytes.__eq__, one, cut[j]))}

    assert 4 <= forest.length <= neardup.LEVELS and met(forest.length) == met(4) and met(4)


def test_tries_hold_what_neighbours_share(spark, near_texts):
    forest = neardup.build_forest(spark.createDataFrame(list(near_texts.items()), "id string, text string"), "id", "text")
    labels = {r["rep"]: r["labels"] for r in forest.sets.collect()}
    near = {(r["tree"], r["rep"]): r["near"] for r in forest.tries.collect()}
    width = 2 * neardup.LEVELS
    for tree in range(0, neardup.TREES, 13):
        cut = {k: v[tree * width : (tree + 1) * width] for k, v in labels.items()}
        for k, v in cut.items():
            shared = max((next((n for n in range(neardup.LEVELS) if v[2 * n : 2 * n + 2] != w[2 * n : 2 * n + 2]), neardup.LEVELS) for o, w in cut.items() if o != k))
            assert near.get((tree, k), 3) >= shared


def test_a_large_cluster_costs_links_in_proportion(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [(f"t{i:05}", " ".join([*base[: rng.randrange(50, 60)], f"n{i}"])) for i in range(3000)]
    seen = []
    real = neardup._verify
    monkeypatch.setattr(neardup, "_verify", lambda forest, pairs: (seen.append(pairs.count()), real(forest, pairs))[1])
    rows = neardup.groups(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()
    assert len(rows) == 3000 and {r["group_id"] for r in rows} == {"t00000"}
    assert seen[0] <= 3000 * neardup.TREES and seen[1] == 0


def test_no_texts_no_pairs(spark):
    df = spark.createDataFrame([(None, None)], "id string, text string")
    pairs, members = neardup.similar_sets(df, "id", "text")
    assert pairs.count() == 0 and members.count() == 0
    assert neardup.groups(df, "id", "text").count() == 0


def test_source_states(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    data = [(" ./a\\b.sql", "old", "p", "r", "tsql", day(1)), ("a/b.sql", "new", "p", "r", "tsql", day(3)), ("././a/b.sql ", "mid", None, None, None, day(2)), ("c", None, None, None, None, None), (None, "x", None, None, None, day(1)), (" ", "x", None, None, None, day(1))]
    df = spark.createDataFrame(data, "source_id string, sql_text string, path string, repository string, lang string, committed_at timestamp")
    assert {(r["source_id"], r["sql_text"]) for r in corpus.source_states(df).collect()} == {("a/b.sql", "new"), ("c", None)}


# ------------------------------------------------------------------ 2 validity
def test_derivatives_of_a_small_grammar():
    g = Grammar("s = 'a' s 'b' | [ 'c' ] { 'd' }")
    assert g.run("aadbb") == ("sound", 5) and g.run("") == ("sound", 0) and g.run("cdd")[0] == "sound"
    assert g.run("aab") == ("ends early", 3) and g.run("aabcb") == ("fails", 3) and g.run("x") == ("fails", 0)
    g._forget()
    assert g.run("aadbb") == ("sound", 5)


SOUND = [
    ("tsql", "CREATE OR ALTER PROCEDURE dbo.[P x] @a int = 1, @b varchar(5) = NULL OUTPUT AS BEGIN SET NOCOUNT ON; SELECT TOP (5) a.*, COUNT(*) OVER (PARTITION BY b ORDER BY c DESC) FROM dbo.T AS a WITH (NOLOCK) LEFT JOIN (SELECT 1 AS z) q ON q.z = a.z WHERE a.x IN (1, 2) AND NOT EXISTS (SELECT 1 FROM u) OR (a.y LIKE N'%''' AND a.z BETWEEN 1 AND -2); END\nGO\n"),
    ("tsql", "-- <<<<<<< HEAD\n/* ======= /* nested */ */\nSELECT '>>>>>>> x' AS [GO\n], \"q\" FROM t;\nGO 5\nPRINT 1"),
    ("tsql", "IF @a = 1 BEGIN EXEC p @x = 'a', @y = 2 OUTPUT; END; ELSE PRINT 'n'"),
    ("tsql", ";WITH a AS (SELECT 1 AS x UNION ALL SELECT 2), b (y) AS (SELECT x FROM a) DELETE FROM t WHERE id IN (SELECT y FROM b);"),
    ("tsql", "CREATE TABLE t (a int IDENTITY(1,1) NOT NULL PRIMARY KEY, b AS a + 1, c decimal(9,2) NULL DEFAULT (0), CONSTRAINT f FOREIGN KEY (a) REFERENCES u (b) ON DELETE CASCADE)"),
    ("tsql", "CREATE FUNCTION f (@a int) RETURNS TABLE AS RETURN (SELECT CASE WHEN @a > 1 THEN CAST(@a AS varchar(5)) ELSE CONVERT(date, @a, 112) END AS z)"),
    ("tsql", "-- only a comment"), ("tsql", ""), ("tsql", " \n"), ("tsql", "Größe: /* x */".replace("Größe:", "-- Größe\n")),
    ("json", '{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}'), ("json", "  "), ("json", "// note"),
    ("xml", '<?xml version="1.0"?>\n<!-- c --><a b="1"><c/>x &amp; y<![CDATA[ < ]]></a>\n'), ("xml", "<!-- only -->"),
    ("python", "# c\nimport os\n@d(1)\ndef f(a, *b, c=1, **k) -> int:\n    '''doc'''\n    if a and not b: return [x for x in b if x % 2]\n    else:\n        pass\n    return {**k, 'a': lambda x: x[1:2, ...]}\nclass A(B): x: int = 1\n"),
    ("python", "match x:\n    case 1: pass\n"),
]
SOUND += [
    ("tsql", text)
    for text in (
        "SELECT IIF(a>1,2,3) FROM t", "SELECT a FROM t GROUP BY GROUPING SETS ((a),(b),())", "SELECT a, count(*) FROM t GROUP BY a WITH ROLLUP", "SELECT * FROM a INNER HASH JOIN b ON a.x=b.x LEFT OUTER LOOP JOIN c ON c.x=b.x",
        "SELECT d AT TIME ZONE 'UTC' AT TIME ZONE 'CET' AS x FROM t", "SELECT * FROM t FOR SYSTEM_TIME AS OF '2020-01-01' AS x", "SELECT * FROM t TABLESAMPLE (10 PERCENT)", "BULK INSERT dbo.t FROM 'c:\\x.csv' WITH (FIELDTERMINATOR = ',', FIRSTROW = 2, TABLOCK)",
        "BACKUP DATABASE db TO DISK = 'x.bak' WITH INIT, COMPRESSION", "RESTORE DATABASE db FROM DISK = 'x.bak' WITH REPLACE, MOVE 'a' TO 'b'", "UPDATE STATISTICS dbo.t ix WITH FULLSCAN", "EXECUTE AS USER = 'bob'; SELECT 1; REVERT",
        "WITH XMLNAMESPACES ('http://x' AS ns) SELECT 1 AS a FOR XML PATH('x')", "SELECT TRY_PARSE('1' AS int USING 'en-US'), PARSE('1' AS int)", "CREATE CLUSTERED COLUMNSTORE INDEX ix ON dbo.t", "CREATE PARTITION FUNCTION pf (int) AS RANGE LEFT FOR VALUES (1, 100)",
        "CREATE PARTITION SCHEME ps AS PARTITION pf ALL TO ([PRIMARY])", "ALTER TABLE t REBUILD WITH (DATA_COMPRESSION = PAGE)", "ALTER TABLE t SWITCH PARTITION 1 TO u PARTITION 2", "ALTER SCHEMA x TRANSFER dbo.t", "ADD SIGNATURE TO dbo.p BY CERTIFICATE c", "SELECT {fn NOW()}, {d '2020-01-01'}",
        "SELECT CASE WHEN (a>1 AND (b<2)) THEN 1 END FROM t WHERE (a+b)*2 > 3 AND (a) = 1", "SELECT (SELECT 1), ((SELECT 2) UNION SELECT 3)", "SELECT * FROM ((SELECT 1 AS a) UNION (SELECT 2)) x", "IF (SELECT COUNT(*) FROM t) > 0 PRINT 'x'", "SELECT hash, at, loop FROM cube",
        "CREATE TABLE t (a int CHECK ((a>1) AND (a<3)), b AS (a+1), c datetime2 GENERATED ALWAYS AS ROW START, PERIOD FOR SYSTEM_TIME (c, d))", "SELECT TRIM(' ' FROM x) FROM t", "CREATE VIEW Pr\u00c3\u00a4mie AS SELECT 1 AS x", "SELECT " + "(" * 3000 + "1" + ")" * 3000, "SELECT 1 FROM t WHERE " + "(" * 3000 + "a = 1" + ")" * 3000,
    )
]
SOUND += [("python", "type X[T] = list[T]\ndef f[T: int, *A](x: T = 1, /, *, y) -> None: ...\nmatch x, y:\n    case [1, *_] | {'a': -2.5, **r} if r: pass\n    case A.B(c, d=e) as f:\n        match = case = type(match)\n")]
UNSOUND = [
    ("tsql", "SELECT a FROM t WHERE", "ends early"), ("tsql", "SELECT 'open", "ends early"), ("tsql", "/* open", "ends early"), ("tsql", "BEGIN SELECT 1;", "ends early"), ("tsql", "SELECT 1;\n<<<<<<< HEAD\nSELECT 2;\n=======\nSELECT 3;\n>>>>>>> x\n", "fails"),
    ("tsql", '{"a": 1}', "fails"), ("tsql", "import sys\nx = [1]\n", "fails"), ("tsql", "SELECT (1 FROM t", "fails"), ("tsql", "SELECT 1 BEGIN\nGO\nEND", "fails"), ("tsql", "UPDATE t SET a = 1 WHERE b", "ends early"),
    ("json", '{"a": 1,}', "fails"), ("json", '{"a": [1, 2', "ends early"), ("json", '{"a": "x', "ends early"), ("json", "{'a': 1}", "fails"), ("json", '{"a": 01}', "fails"),
    ("xml", "<a><b></a>", "fails"), ("xml", "<a><b>", "ends early"), ("xml", "<a", "ends early"), ("xml", "<a>&nbsp;</a>", "fails"), ("xml", "<a/><b/>", "fails"),
    ("tsql", "SELECT a FROM t WHERE (a = 1 OR", "ends early"), ("tsql", "SELECT " + "(" * 3000, "ends early"), ("tsql", "SELECT “a” FROM t", "fails"), ("python", 'x = """was old', "ends early"),
    ("python", "def f(:\n  pass\n", "fails"), ("python", "x = [1,\n", "ends early"), ("python", "if x:\n", "ends early"), ("python", "x = 'a\n", "ends early"), ("python", "  x = 1\n y = 2\n", "fails"),
]


@pytest.mark.parametrize(("lang", "text"), SOUND)
def test_sound_texts(lang, text):
    assert examine(text, lang)[0] == "sound"


@pytest.mark.parametrize(("lang", "text", "verdict"), UNSOUND)
def test_unsound_texts(lang, text, verdict):
    got, at = examine(text, lang)
    assert got == verdict and 0 <= at <= len(text)


def test_python_files_of_the_library_are_sound():
    import ast
    import pathlib

    checked = 0
    for path in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[::4]:
        text = path.read_text(encoding="utf-8", errors="replace")
        assert examine(text, "python")[0] == "sound", path
        checked += 1
    assert checked > 20


def test_python_and_json_verdicts_agree_with_the_readers():
    import ast
    import json
    import pathlib

    text = pathlib.Path(neardup.__file__).read_text()
    rng = random.Random(3)
    assert examine(text, "python")[0] == "sound"
    for _ in range(60):
        cut = text[: rng.randrange(len(text))]
        try:
            ast.parse(cut)
            sound = True
        except (SyntaxError, ValueError):
            sound = False
        assert (examine(cut, "python")[0] == "sound") == sound
    doc = json.dumps({"a": [1, {"b": None, "c": "x,}"}], "d": 1.5})
    for i in range(1, len(doc)):
        for bad in (doc[:i], doc[:i] + doc[i + 1 :]):
            try:
                json.loads(bad)
                sound = True
            except ValueError:
                sound = False
            assert (examine(bad, "json")[0] == "sound") == sound, bad


def test_examine_sources_rates_and_hints(spark):
    data = [("a.sql", "SELECT 1", None, "r", "tsql"), ("b.sql", "SELECT", None, "r", " TSQL "), ("c.json", "{", None, None, None), ("d.txt", "???", None, None, "cobol"), ("e.py", None, None, None, "python"), ("f.xml", "", "x", None, "xml")]
    states = spark.createDataFrame(data, "source_id string, sql_text string, path string, repository string, lang string").withColumn("verdict", F.lit(1))
    out = validity.examine_sources(states)
    assert {r["source_id"]: r["verdict"] for r in out.collect()} == {"a.sql": "sound", "b.sql": "ends early", "c.json": "ends early", "d.txt": "sound", "e.py": "sound", "f.xml": "sound"}
    assert {(r["repository"], r["lang"]): r["rate"] for r in validity.rates(out).collect()}[("r", "tsql")] == 0.5
    runs = spark.createDataFrame([("./b.sql", ["x"]), ("b.sql", None), ("c.json", [])], "source_id string, diagnostics array<string>")
    assert {r["source_id"]: r["hinted"] for r in validity.with_hints(out.filter("verdict <> 'sound'"), runs).collect()} == {"b.sql": True, "c.json": False}
    assert validity.examine_sources(states.limit(0)).count() == 0
    day = lambda n: dt.datetime(2024, 1, n)
    told = spark.createDataFrame([("./a", "SELECT", "tsql", day(1)), ("a ", "SELECT 1", "tsql", day(2)), ("b", "SELECT 1", "tsql", day(1)), ("b", "SELECT", "tsql", day(1)), ("c", "SELECT", "tsql", None), (None, "SELECT", "tsql", day(1))], "source_id string, sql_text string, lang string, t timestamp").withColumns({"path": F.lit("x"), "repository": F.lit("r"), "time": F.lit(0)})
    assert {r["source_id"]: r["verdict"] for r in validity.examine_sources(told, latest="t").collect()} == {"a": "sound", "b": "ends early", "c": "ends early"}


# ----------------------------------------------------------------- 4 encodings
CLEAN = ["-- Prüfung der Übersicht für Währung größere Beträge", "-- niño también código según AÇÃO SÃO não Âmbito", "-- удалить таблица клиентов перед закрытием", "-- ├── stock m³ ±2 « données » § déjà à", "-- 更新表 检查余额 审批", "SELECT ShelfPrämie FROM dbo.Orders WHERE CustomerName = N'x'"]


def _garble(text, written, read):
    return text.encode(written).decode(read, "replace")


def test_garbled_texts_are_found_and_restored(spark):
    rows = [("clean", f"c{i}-{j}", f"{t} {j}") for j in range(24) for i, t in enumerate(CLEAN)]  # different texts; copies would not count
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "utf-8"), ("cp1252", "utf-8")]
    want = {}
    for written, read in chains:
        for i, t in enumerate(CLEAN[:5]):
            try:
                bad = _garble(t, written, read)
            except UnicodeEncodeError:
                continue
            if bad != t:
                want[f"{written}-{read}-{i}"] = (bad, t)
    want["twice"] = (_garble(_garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[0])
    even = CLEAN[5].replace("ä", "a")
    even += " " * (len(even) % 2)
    want["units"] = (even.encode("ascii").decode("utf-16-le"), even)
    want["bytes"] = (even.encode("utf-16-le").decode("latin-1"), even)
    rows += [("bad", k, b) for k, (b, _) in want.items()] + [("clean", "null", None), ("clean", "empty", ""), ("clean", "ascii", "plain"), ("clean", "long", "größere " * 50000)]
    df = spark.createDataFrame(rows, "table_name string, record_key string, text string").withColumn("kind", F.lit(9)).withColumn("word", F.lit("w"))
    found, _ = mojibake.find_garbled(df)
    assert {(r["table_name"], r["record_key"]) for r in found.collect()} == {("bad", k) for k in want}
    restored = {r["record_key"]: r for r in mojibake.restore(df.select("table_name", "record_key", "text")).collect()}
    assert set(restored) == set(want)
    exact = [k for k in want if "utf-8" in k[:5] or k in ("twice", "units", "bytes")]
    assert [k for k in exact if restored[k]["restored"] != want[k][1]] == []


def test_long_garbled_words_are_found_and_restored(spark):
    word = "更新表检查余额审批" * 300
    bad = {c: word.encode("utf-8").decode(c) for c in ("latin-1", "cp437", "mac_roman")}
    rows = [("clean", "c", f"-- {word} x")] + [("bad", c, f"-- {b} x") for c, b in bad.items()]
    df = spark.createDataFrame(rows, "table_name string, record_key string, text string")
    assert {r["record_key"] for r in mojibake.find_garbled(df)[0].collect()} == set(bad)
    assert {r["record_key"]: (r["restored"], r["complete"]) for r in mojibake.restore(df).collect()} == {c: (f"-- {word} x", True) for c in bad}


def test_garbled_copies_outnumber_the_clean_text(spark):
    lines = ["-- Prüfung der Übersicht für größere Beträge", "-- удалить таблица клиентов перед закрытием", "-- niño código según también"]
    rows = [("clean", f"c{i}", t) for i, t in enumerate(lines)]
    rows += [("bad", f"b{i}-{j}", _garble(lines[i], w, r)) for i, w, r in [(0, "cp1252", "mac_roman"), (1, "koi8_r", "cp1251"), (2, "mac_roman", "cp1252")] for j in range(5)]
    df = spark.createDataFrame(rows, "table_name string, record_key string, text string")
    assert {r["record_key"] for r in mojibake.find_garbled(df)[0].collect()} == {k for n, k, _ in rows if n == "bad"}


def test_what_is_odd_in_a_word():
    usual = ["Übersicht", "¿falta", "l’année", "ReadingÜbersicht", "n°5", "AÇÃO", "更新表の", "データ", "─┐", "größte_2"]
    assert {w: mojibake.oddness(w) for w in usual} == dict.fromkeys(usual, 0)
    assert all(mojibake.oddness(w) for w in ["supprimÈ", "Pr¸fung", "Reading†bersicht", "aбc", "x\x81y"])


@pytest.mark.parametrize("chain", [("cp1252", "cp437"), ("cp1252", "latin-1"), ("mac_roman", "cp437"), ("cp866", "koi8_r"), ("latin-1", "cp850")])
def test_two_readings_one_after_the_other(spark, chain):
    clean = "-- größere Übersicht für Prüfung"
    once = clean.encode().decode(chain[0], "ignore")
    bad = once.encode().decode("latin-1").translate(mojibake._table(chain[1])[0])
    df = spark.createDataFrame([("clean", "c", clean), ("bad", "b", bad)], "table_name string, record_key string, text string")
    assert [r["record_key"] for r in mojibake.find_garbled(df)[0].collect()] == ["b"]


def test_the_filter_of_words_loses_none(spark):
    keys = [(i % 3, f"wört{i}") for i in range(4000)]
    present = mojibake._present(spark.createDataFrame(keys, "kind int, form string"), len(keys))
    assert all(present.may_hold(*k) for k in keys)
    assert sum(present.may_hold(k, "x" + w) for k, w in keys) < 300
    assert mojibake._present(spark.createDataFrame(keys, "kind int, form string"), 10**9).may_hold(0, "anything")


def test_no_garbled_text_in_nothing(spark):
    empty = spark.createDataFrame([], "table_name string, record_key string, text string")
    assert mojibake.find_garbled(empty)[0].count() == 0


# -------------------------------------------------------------------- 7 tokens
@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_token_ids_equal_those_of_the_library(spark, reference_tokenizer):
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n  x\t", "aaaaaaaaaaa aaaa aaa", "<|endoftext|>", "don't I'll 'S", "naïve 𝒳 👩\u200d💻 ｆｕｌｌ", "x" * 3000, " " * 500 + "a", "ab" * 4000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "text", ["doc_id"], tokens.tokenizer_file()).collect()}
    assert got == {i: reference_tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encode(df, "text", ["doc_id"], tokens.tokenizer_file(), count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0), "text", ["doc_id"], tokens.tokenizer_file()).count() == 0


def test_memo_that_starts_anew_changes_nothing(monkeypatch, reference_tokenizer):
    monkeypatch.setattr(tokens, "KEPT_PRETOKENS", 3)
    encoder = tokens.Encoder(tokens.tokenizer_file())
    for text in ["one two three four", "five six", "one two"]:
        assert encoder.encode([text])[0].tolist() == reference_tokenizer.encode(text).ids


# -------------------------------------------------------------------- 8 mixing
def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([" Big", "big", "BIG\t"]), rng.randrange(0, 30)) for i in range(600)] + [(1000 + i, "small", 20) for i in range(10)] + [(2000 + i, "tiny", 10) for i in range(2)] + [(3000, None, 50), (3001, "untargeted", 50), (3002, "big", None)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, n_tokens long").withColumn("_pos", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.3, 4), ("tiny", 0.1, 2), ("absent", 0.1, 3), ("big", None, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(sizes, targets, total_tokens=2000)
    out = {r["source"]: r for r in report.collect()}
    used = Counter()
    for r in mixed.collect():
        used[r["source"]] += r["n_tokens"] * r["repeats"]
        assert r["repeats"] <= {"big": 1, "small": 4, "tiny": 2}[r["source"]]
    assert {s: r["tokens_used"] for s, r in out.items() if r["tokens_used"]} == dict(used)
    assert 0 <= out["big"]["budget"] - used["big"] < 30
    assert used["small"] == 600 and out["small"]["epochs"] == 3
    assert used["tiny"] == 40 and out["tiny"]["share_of_total"] < 0.1
    assert out["absent"]["tokens_used"] == 0 and out["untargeted"]["tokens_used"] == 0 and out[""]["documents"] == 1
    assert mixed.select("doc_id").distinct().count() == mixed.count()
    again, _ = mixing.mix(sizes.repartition(5), targets, total_tokens=2000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_mix_of_nothing(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(sizes, targets)
    assert mixed.count() == 0 and report.first()["tokens_used"] == 0


# ---------------------------------------------------------------- 9 look-alikes
def unified(*texts):
    return lookalike.unify_texts(pa.array(list(texts), type=pa.string())).to_pylist()


def test_composition_equals_nfc():
    rng = random.Random(9)
    letters = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.decomposition(c) and unicodedata.decomposition(c)[0] != "<"]
    marks = [chr(m) for m in (0x300, 0x301, 0x302, 0x303, 0x308, 0x30A, 0x327, 0x328, 0x323, 0x31B)]
    texts = ["".join(rng.choice([rng.choice(letters), rng.choice("abcxyz"), rng.choice(marks), chr(rng.randrange(0xAC00, 0xD7A3))]) for _ in range(rng.randrange(1, 30))) for _ in range(800)]
    want = [unicodedata.normalize("NFC", t) for t in texts]
    assert unified(*texts) == want
    assert unified(*(unicodedata.normalize("NFD", t) for t in texts)) == want


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ａｂｃ１（", "Abc1("), ("a\u200bb\u00ad\ufeff", "ab"), ("a\u00a0b\u2007c\u3000d", "a b c d"), ("e\u0301", "é"), ("раусе", "payce"), ("ΑΒΕΖ", "ABEZ"), ("\u1112\u1161\u11ab", "한"), ("ﬁn", "fin"), ("👩\u200d💻", "👩💻"), ("ё", "ë"), ("а\u0301", "á"), ("ｶﾞ", "ガ"), ("ν", "v"), ("ρ", "p"), ("ӏ", "l"), ("Ѵ", "V"), ("ոսհՏ", "nuhS"), ("ᎪᏢ", "AP"), ("ⲘⲟⲢ", "MoP"), ("ꓮꓳ", "AO"), ("ό", "ó"), ("𝐀𝑏", "Ab")],
)
def test_equal_looking_texts_become_equal(a, b):
    assert unified(a)[0] == unified(b)[0]


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("a-b", "a_b"), ("ÀB", "AB"), ("a  b", "a b"), ("", " "), ("l", "1"), ("ñ", "n")])
def test_visible_differences_stay(a, b):
    assert unified(a)[0] != unified(b)[0]


def test_nulls_and_borders_between_texts():
    assert unified(None, "", "e", "\u0301e", None, "x\u0301") == [None, "", "e", "\u0301e", None, "x\u0301"]
    assert lookalike.unify_texts(pa.array([], type=pa.string())).to_pylist() == []
    assert lookalike.unify_texts(pa.array(["no", "é", "ｘ"], type=pa.string()).slice(1)).to_pylist() == ["é", "x"]


def test_lookalike_pairs(spark, rows):
    data = [(1, "data set"), (2, "data\u00a0set"), (3, "dаta set"), (4, "data set"), (5, "Data set"), (6, None), (7, ""), (8, "\u200b"), (9, "unique"), (10, "ｄ" * 100000), (11, "d" * 100000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("exact", F.lit("y"))
    assert rows(lookalike.lookalike_pairs(df, "text", "doc_id")) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert {r["doc_id"]: r["unified"] for r in lookalike.unified(df, "text", ["doc_id"]).collect()}[6] is None
    assert lookalike.lookalike_pairs(df.limit(0), "text", "doc_id").count() == 0
    assert rows(lookalike.lookalike_classes(df, "text", "doc_id")) == [(1, 1, 3, 4), (2, 1, 3, 4), (3, 1, 3, 4), (4, 1, 3, 4), (10, 10, 2, 2), (11, 10, 2, 2)]
    assert lookalike.lookalike_classes(df.limit(0), "text", "doc_id").count() == 0


def test_many_copies_of_one_text_and_one_variant(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1234, "licence\u00a0text").otherwise("licence text").alias("text"))
    found = lookalike.lookalike_pairs(df, "text", "doc_id")
    assert found.count() == 2999 and found.filter("a = 1234 or b = 1234").count() == 2999
