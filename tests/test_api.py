from __future__ import annotations

from skein.api import Analyzer, Cursor


def test_texts_without_identity_fall_together(spark):
    a = Analyzer(spark, ["EXEC dbo.P", "SELECT 1 FROM dbo.T; EXEC (@x)", None or ""])
    assert sorted(tuple(r) for r in a.cross_references().collect()) == [("UnnamedScript", "dbo.P", "execute"), ("UnnamedScript", "dbo.T", "read")]
    assert a.dynamic_object_count() == 1 and a.incoming("DBO.p").count() == 1
    assert a.tokens().filter("kind = 'identifier'").count() == 8
    one = Analyzer(spark, "CREATE VIEW dbo.V AS SELECT * FROM dbo.V")
    assert one.rules(rule_ids=["SQL001"]).findings.first()["message"] == "Self-referencing SQL object detected: dbo.V"


def test_cursor():
    c = Cursor("select (x) from t")
    assert c.take("FROM") is None and c.take("SELECT").value == "select" and c.take(symbol="(").value == "("
    c.skip_to("FROM")
    assert c.take().word == "FROM" and c.peek().value == "t" and c.peek(1) is None


def test_public_names_and_lines(spark):
    import skein

    assert all(getattr(skein, name) is not None for name in skein.__all__)
    a = skein.Analyzer(spark, "CREATE VIEW dbo.V AS SELECT * FROM dbo.T")
    assert sorted(r["line"] for r in skein.graph_lines(a.graph).collect()) == [
        '{"name":"dbo.T","object_type":"Unknown"}', '{"name":"dbo.V","object_type":"View"}', '{"source":"dbo.V","target":"dbo.T","kind":"references"}',
    ]
    tree = skein.impact_tree(a.impact_paths("dbo.t")).collect()
    assert sorted((r["name"], r["parent"], r["depth"]) for r in tree) == [("dbo.T", None, 0), ("dbo.V", "dbo.T", 1)]
