"""T-SQL corpora made from the rows of business tables.

Each function returns sources (source_id, sql_text, path). Every row becomes
real T-SQL text that runs through lexing, parsing and graph building, while the
right answer stays visible in the rows' keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sources(df: DataFrame, folder: str, key: Column, *text: Column | str) -> DataFrame:
    parts = [F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]
    return df.select(F.concat(F.lit(f"{folder}/"), key.cast("string"), F.lit(".sql")).alias("source_id"), F.concat(*parts).alias("sql_text"), F.lit(None).cast("string").alias("path"))


c = F.col


def lineage(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame | None) -> DataFrame:
    """Orders, customers and nations as views, each reading the next; regions as tables, or undefined."""
    out = _sources(orders, "orders", c("o_orderkey"), "-- order ", c("o_orderkey"), "\nCREATE VIEW dbo.O", c("o_orderkey"), " AS\nSELECT * FROM dbo.C", c("o_custkey"), " AS x;\n")
    out = out.unionByName(_sources(customer, "customers", c("c_custkey"), "CREATE VIEW [dbo].[C", c("c_custkey"), "]\nAS SELECT n.* FROM DBO.N", c("c_nationkey"), " n /* nation */;\nGO\n"))
    out = out.unionByName(_sources(nation, "nations", c("n_nationkey"), "create view dbo.N", c("n_nationkey"), " as select 'from dbo.X' as t from dbo.R", c("n_regionkey"), " as r;"))
    if region is not None:
        out = out.unionByName(_sources(region, "regions", c("r_regionkey"), "CREATE TABLE dbo.R", c("r_regionkey"), " (id int NOT NULL, name varchar(20) DEFAULT 'x');"))
    return out


def order_procedures(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Order procedures that execute their customer's procedure if final, else read it."""
    verb = F.when(c("o_orderstatus") == "F", F.concat(F.lit("EXEC dbo.C"), c("o_custkey").cast("string"), F.lit(" @a = 1"))).otherwise(F.concat(F.lit("SELECT 1 FROM dbo.C"), c("o_custkey").cast("string")))
    out = _sources(orders, "orders", c("o_orderkey"), "CREATE PROCEDURE dbo.O", c("o_orderkey"), " AS BEGIN\nSET NOCOUNT ON;\n", verb, ";\nEND\nGO\n")
    return out.unionByName(_sources(customer, "customers", c("c_custkey"), "CREATE PROCEDURE dbo.C", c("c_custkey"), " @a int = 0 AS SELECT @a;"))


def event_rings(events: DataFrame) -> DataFrame:
    """Each user's events in order as views reading the next one; even users' last view reads the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    ring = events.withColumn("rn", F.row_number().over(w)).withColumn("n", n)
    following = F.when(c("rn") < c("n"), c("rn") + 1).when(c("user_id") % 2 == 0, F.lit(1))
    read = F.when(following.isNotNull(), F.concat(F.lit(" FROM dbo.U"), c("user_id").cast("string"), F.lit("_"), following.cast("string"))).otherwise(F.lit(""))
    return _sources(ring, "events", F.concat(c("user_id").cast("string"), F.lit("_"), c("rn").cast("string")), "CREATE VIEW dbo.U", c("user_id"), "_", c("rn"), " AS SELECT 1 AS one", read, ";")


def supplier_triggers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Suppliers as triggers that read their nation's table."""
    out = _sources(supplier, "suppliers", c("s_suppkey"), "CREATE TRIGGER dbo.S", c("s_suppkey"), " ON dbo.Hook AFTER INSERT AS SELECT * FROM dbo.N", c("s_nationkey"), ";")
    return out.unionByName(_sources(nation, "nations", c("n_nationkey"), "CREATE TABLE dbo.N", c("n_nationkey"), " (id int);"))


def part_procedures(part: DataFrame) -> DataFrame:
    """Parts as procedures with typed parameters, variables, a temporary table and dynamic SQL for some."""
    dynamic = F.when(c("p_size") % 2 == 0, F.lit("EXEC (@sql);\n")).otherwise(F.lit(""))
    return _sources(
        part, "parts", c("p_partkey"),
        "CREATE PROCEDURE dbo.P", c("p_partkey"), "\n  @Id bigint,\n  @Size decimal(18,4) = ", c("p_size"), ",\n  @Name nvarchar(", c("p_size"), ") = NULL OUTPUT\nAS\nBEGIN\nDECLARE @Local", c("p_size"),
        " int;\nSET @Id = 1;\nSET @Other = 2;\nSELECT * INTO #Stage FROM dbo.Parts p;\n", dynamic, "END\nGO\nSELECT 1 FROM dbo.After", c("p_partkey"), ";",
    )


def line_forms(lineitem: DataFrame) -> DataFrame:
    """Line items as scripts in one of three forms, by return flag: CTE and temporary table, UPDATE by alias, MERGE."""
    key = F.concat(c("l_orderkey").cast("string"), F.lit("_"), c("l_linenumber").cast("string"))
    part, supp = c("l_partkey").cast("string"), c("l_suppkey").cast("string")
    cte = F.concat(F.lit("WITH q AS (SELECT 1 AS a FROM dbo.P"), part, F.lit(") SELECT * INTO #t FROM q JOIN OPENJSON(@j) AS j ON 1 = 1 JOIN dbo.S"), supp, F.lit(" s ON s.a = q.a;"))
    upd = F.concat(F.lit("UPDATE t SET t.x = 1 FROM dbo.P"), part, F.lit(" AS t JOIN #tmp AS z ON z.a = t.a; UPDATE z SET z.x = 2 FROM #tmp z;"))
    mrg = F.concat(F.lit("MERGE INTO dbo.P"), part, F.lit(" AS tgt USING dbo.S"), supp, F.lit(" AS src ON tgt.a = src.a WHEN MATCHED THEN UPDATE SET tgt.a = src.a;"))
    text = F.when(c("l_returnflag") == "A", cte).when(c("l_returnflag") == "N", upd).otherwise(mrg)
    return _sources(lineitem, "lines", key, text)


def order_batches(lineitem: DataFrame) -> DataFrame:
    """One file for each order: a procedure for each line, split by GO, reading its part and executing its supplier."""
    one = F.concat(
        F.lit("CREATE PROCEDURE dbo.L"), c("l_orderkey").cast("string"), F.lit("_"), c("l_linenumber").cast("string"), F.lit(" AS\nBEGIN\nSELECT * FROM dbo.P"), c("l_partkey").cast("string"),
        F.lit(";\nEXEC dbo.S"), c("l_suppkey").cast("string"), F.lit(";\nEND\nGO\n"),
    )
    per = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("t")))).alias("x"))
    return _sources(per, "batches", c("l_orderkey"), F.array_join("x.t", ""))


def nation_tables(nation: DataFrame) -> DataFrame:
    """Nations as tables with a foreign key to their region; a column reference without one is ignored."""
    return _sources(nation, "tables", c("n_nationkey"), "CREATE TABLE dbo.N", c("n_nationkey"), " (id int, r int, CONSTRAINT fk FOREIGN KEY (r) REFERENCES dbo.R", c("n_regionkey"), " (id));\nGRANT REFERENCES ON dbo.X TO u;")


def supplier_scripts(supplier: DataFrame) -> DataFrame:
    """Suppliers as files with three script batches around a table, each batch with variables of its own."""
    key = c("s_suppkey")
    return _sources(
        supplier, "scripts", key,
        "DECLARE @First", key, " int; SELECT 1 FROM dbo.Before", key, ";\nGO\nCREATE TABLE dbo.Local", key, " (i int);\nGO\nDECLARE @Second int; SET @first", key,
        " = 2; SELECT 1 FROM dbo.Middle", c("s_nationkey"), ";\nGO\nSET @Third = 1; EXEC dbo.After", key, "; SELECT 1 FROM DBO.BEFORE", key, ";",
    )
