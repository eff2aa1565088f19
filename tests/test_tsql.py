"""Tokens, statements and evidence of single texts."""

from __future__ import annotations

import random

import pytest

from skein.functions import tsql


def one(text, **kw):
    found = tsql.parse(text, **kw)
    assert len(found) == 1, found
    return found[0]


def refs(obj):
    return [(r["database"], r["schema"], r["name"], r["kind"]) for r in obj["references"]]


def names(obj):
    return [r["name"] for r in obj["references"]]


def kinds(text):
    return [(t.kind, t.value) for t in tsql.tokenize(text)]


# ------------------------------------------------------------------- tokens
def test_tokens_of_every_kind():
    assert kinds("SELECT [a]]b].c, 'it''s' -- x\n/* y */ #t.c @@x ##g \"q\"\"q\" 12 <= ;") == [
        ("identifier", "SELECT"), ("identifier", "[a]]b].c"), ("symbol", ","), ("literal", "'it''s'"), ("identifier", "#t.c"), ("identifier", "@"), ("identifier", "@x"),
        ("identifier", "#"), ("identifier", "#g"), ("literal", '"q""q"'), ("identifier", "12"), ("operator", "<"), ("operator", "="), ("symbol", ";"),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [("/* ab", [("identifier", "b")]), ("/*", []), ("/*a", [("identifier", "a")]), ("/*/", [("operator", "/")]), ("'open", [("literal", "'open")]), ("[open.x", [("identifier", "[open.x")]), ("db..T", [("identifier", "db"), ("operator", "."), ("operator", "."), ("identifier", "T")]), ("a.[b c].d", [("identifier", "a.[b c].d")]), ("--", []), ("-", [("operator", "-")])],
)
def test_unterminated_and_odd_lexemes(text, want):
    assert kinds(text) == want


def test_positions_are_code_points_and_tokens_cover_the_text():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("ab[]'\"-/*.;,()#@ \n$_é𝒳ß1") for _ in range(rng.randrange(30)))
        end = 0
        for t in tsql.tokenize(text):
            assert text[t.position : t.position + len(t.value)] == t.value and t.position >= end
            end = t.position + len(t.value)


def test_names():
    assert tsql.name_parts("[My.T].[a]]b]. x .") == ["My.T", "a]b", "x"]
    assert tsql.qualified("srv.db.s.t") == ("t", "s", "db")
    assert tsql.qualified("") == (None, None, None)
    assert tsql.last_part("dbo.[X Y]") == "x y"


# ------------------------------------------------------------------- objects
def test_view_with_cte_three_part_name_and_derived_table():
    obj = one("CREATE VIEW [reporting].[Order Summary] AS WITH recent AS (SELECT * FROM [OtherDb].[sales].[Order Header]) SELECT * FROM recent r JOIN crm.[Customer Master] c ON 1=1 JOIN (SELECT x FROM audit.[Order Flags]) f ON 1=1")
    assert (obj["schema"], obj["name"], obj["object_type"]) == ("reporting", "Order Summary", "View")
    assert refs(obj) == [("OtherDb", "sales", "Order Header", "reference"), (None, "crm", "Customer Master", "reference"), (None, "audit", "Order Flags", "reference")]


def test_merge_and_update_alias():
    obj = one("MERGE INTO sales.[Order Fact] AS t USING stage.[Order Stage] AS s ON t.i=s.i WHEN MATCHED THEN UPDATE SET t.a=s.a; UPDATE f SET f.x=1 FROM sales.[Order Fact] f JOIN crm.[Customer Master] c ON 1=1;")
    assert sorted(names(obj)) == ["Customer Master", "Order Fact", "Order Stage"]


def test_two_procedures_keep_their_evidence():
    a, b = tsql.parse("CREATE PROCEDURE dbo.ProcA @Id int AS BEGIN DECLARE @LocalA int; SELECT * INTO #StageA FROM dbo.SourceA; EXEC sp_executesql @sql; END\nGO\nCREATE PROCEDURE dbo.ProcB @Code int AS DECLARE @LocalB int; SELECT 1 FROM SourceB; EXEC dbo.HelperB;\nGO\n")
    assert [p["name"] for p in a["parameters"]] == ["@Id"] and [v["name"] for v in a["variables"]] == ["@LocalA"]
    assert names(a) == ["SourceA", "sp_executesql"] and a["temporary_tables"] == ["#StageA", "#"] and a["dynamic_sql"]
    assert [p["name"] for p in b["parameters"]] == ["@Code"] and names(b) == ["SourceB", "HelperB"] and not b["dynamic_sql"]


def test_seven_parameters():
    obj = one("CREATE PROCEDURE dbo.P @A bigint, @B bigint = 0, @C nvarchar(30) = NULL, @D nvarchar(max), @E decimal(18,4) = 0, @F datetime2(3), @G bit OUTPUT AS SET @A = 1; DECLARE @LocalBatchId int; SET @LocalStatus = 1;")
    assert [p["datatype"] for p in obj["parameters"]] == ["bigint", "bigint", "nvarchar", "nvarchar", "decimal", "datetime2", "bit"]
    assert [p["default_value"] for p in obj["parameters"]] == [None, "0", "NULL", None, "0", None, None]
    assert [p["output"] for p in obj["parameters"]] == [False] * 6 + [True]
    assert [v["name"] for v in obj["variables"]] == ["@LocalBatchId", "@LocalStatus"]


def test_wrapped_function_parameters():
    obj = one("CREATE FUNCTION dbo.F (@a decimal(18,4), @b int = 1) RETURNS int AS BEGIN RETURN @a END")
    assert [(p["name"], p["datatype"], p["default_value"]) for p in obj["parameters"]] == [("@a", "decimal", None), ("@b", "int", "1")]


def test_rowset_functions_and_temporary_tables_are_no_references():
    obj = one("CREATE PROCEDURE dbo.P AS CREATE TABLE #Stage (i int); INSERT INTO #Stage SELECT * FROM OPENJSON(@j) WITH (i int) AS src JOIN dbo.ReferenceData r ON 1=1; UPDATE s SET s.i=1 FROM #Stage s;")
    assert names(obj) == ["ReferenceData"] and obj["temporary_tables"] == ["#Stage", "#"]


def test_foreign_keys_and_permissions():
    found = tsql.parse("CREATE TABLE dbo.A (i int, FOREIGN KEY (i) REFERENCES dbo.B (i));\nGRANT REFERENCES ON dbo.X TO u;\nGO\nIF OBJECT_ID('x') IS NULL CREATE TABLE dbo.C (i int);")
    assert [(o["name"], names(o)) for o in found] == [("A", ["B"]), ("C", [])]


def test_script_scopes_of_a_source_merge():
    found = tsql.parse("SELECT 1 FROM BeforeTarget;\nGO\nCREATE TABLE dbo.LocalTable (i int);\nGO\nSELECT 1 FROM AfterTarget; EXEC (@s); EXEC sp_executesql @s; SELECT 1 FROM beforetarget", "f/x.sql")
    assert [(o["name"], names(o), o["dynamic_sql"]) for o in found] == [("script:f/x.sql", ["BeforeTarget", "AfterTarget", "sp_executesql"], True), ("LocalTable", [], False)]


@pytest.mark.parametrize("text", [None, "", " \n\t", "-- only\n/* comments */", ";;;", "GO\nGO"])
def test_texts_without_objects(text):
    assert tsql.parse(text, "s") == []


# Behaviours that are easy to lose, one text each: (text, object names, reference names).
QUIRKS = [
    ("CREATE PROC p AS SELECT 1 FROM t", ["UnnamedScript"], ["t"]),
    ("ALTER PROCEDURE p AS SELECT 1 FROM t", ["UnnamedScript"], ["t"]),
    ("GRANT EXECUTE ON dbo.P TO r", ["UnnamedScript"], ["ON"]),
    ("CREATE PROCEDURE q WITH EXECUTE AS OWNER AS EXEC dbo.X", ["q"], ["AS"]),
    ("UPDATE STATISTICS t", ["UnnamedScript"], ["STATISTICS"]),
    ("UPDATE TOP (5) t SET a=1", ["UnnamedScript"], ["TOP"]),
    ("CREATE TRIGGER tr ON t AFTER UPDATE AS SELECT 1", ["tr"], ["AS"]),
    ("SELECT * FROM a, b", ["UnnamedScript"], ["a"]),
    ("DELETE t; INSERT t VALUES (1); TRUNCATE TABLE t; DROP TABLE t; ALTER TABLE t ADD c int", [], []),
    ("SELECT * FROM db..T", ["UnnamedScript"], ["db"]),
    ("WITH Orders AS (SELECT 1 AS a) SELECT * FROM dbo.Orders", [], []),
    ("ALTER TABLE c ADD CONSTRAINT k FOREIGN KEY (a) REFERENCES p (a)", ["UnnamedScript"], ["p"]),
    ("CREATE TABLE dbo.A (i int REFERENCES dbo.B (i))", ["A"], []),
    ("IF EXISTS(SELECT 1 FROM sys.x) CREATE TABLE dbo.A (i int)", ["A"], ["x"]),
    ('SELECT * FROM "My Table"', [], []),
    ("CREATE TABLE dbo.A (i int); SELECT * FROM dbo.Z", ["A"], ["Z"]),
    ("UPDATE dbo.f SET a=1 FROM dbo.T f", ["UnnamedScript"], ["T"]),
    ("CREATE VIEW v AS SELECT 1; CREATE TABLE inside (i int); SELECT 1 FROM t", ["v"], ["t"]),
    ("CREATE VIEW v AS SELECT 1; IF 1=1 CREATE TABLE taken (i int); SELECT 1 FROM t", ["v", "taken"], ["t"]),
    ("CREATE INDEX ix ON t (a)", [], []),
    ("CREATE VIEW v AS SELECT 1\nGO 5\nSELECT 1 FROM t", ["v"], ["t"]),
    ("CREATE VIEW v AS SELECT 1\n go \nSELECT 1 FROM t", ["v", "UnnamedScript"], ["t"]),
    ("EXEC (@sql)", ["UnnamedScript"], []),
    ("EXEC @rc = dbo.P @a", ["UnnamedScript"], ["P"]),
]


@pytest.mark.parametrize(("text", "objects", "references"), QUIRKS)
def test_quirks(text, objects, references):
    found = tsql.parse(text)
    assert [o["name"] for o in found] == objects
    assert [r for o in found for r in names(o)] == references


def test_default_is_one_token_and_only_the_first_declared_variable_counts():
    obj = one("CREATE PROCEDURE p @a int = -1, @b nvarchar(5) = N'x' AS DECLARE @c int, @d int")
    assert [p["default_value"] for p in obj["parameters"]] == ["-", "N"]
    assert [v["name"] for v in obj["variables"]] == ["@c"]


def test_long_text_is_read_in_linear_time():
    text = "SELECT * FROM dbo.T WHERE a IN (" + ",".join(["'" + "x" * 50 + "'"] * 20000) + ");" + "/*" + "y" * 1_000_000 + "*/"
    assert names(one(text)) == ["T"]
