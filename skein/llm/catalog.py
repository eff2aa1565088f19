"""Queries of the training-data operators by name, and SQL where it can tell the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.names import normal_source_id
from skein.llm import corpus, lookalike, mixing, mojibake, neardup, tokens, validity
from skein.runtime import load, spread


def _named_sources(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "sql_source")).withColumn("source_id", normal_source_id("source_id")).filter("source_id <> ''")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sources whose texts share at least 0.7 of their runs of three words."""
    pairs = neardup.member_pairs(*neardup.similar_sets(_named_sources(spark, d), "source_id", "sql_text", latest="committed_at"))
    return pairs.select(F.col("id_a").alias("source_id_a"), F.col("id_b").alias("source_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each source: the least source of the group it belongs to."""
    everyone = load(spark, d, "sql_source").select(normal_source_id("source_id").alias("source_id")).filter("source_id <> ''").distinct()
    found = neardup.groups(_named_sources(spark, d), "source_id", "sql_text", latest="committed_at").withColumnRenamed("id", "source_id")
    return everyone.join(found, "source_id", "left").select("source_id", F.coalesce("group_id", "source_id").alias("group_id"))


def _examined(spark: SparkSession, d: str) -> DataFrame:
    return validity.examine_sources(spread(load(spark, d, "sql_source")), latest="committed_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose latest state does not parse as its language."""
    return _examined(spark, d).filter("verdict <> 'sound'").select("source_id")


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every unsound source: how it fails, where, and whether a parser run hinted at it."""
    return validity.with_hints(_examined(spark, d).filter("verdict <> 'sound'"), load(spark, d, "parser_context"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(_examined(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    sources, entries = load(spark, d, "sql_source", "sql_file_entry")
    states = corpus.source_states(sources).select(F.lit("sql_source").alias("table_name"), F.col("source_id").alias("record_key"), F.col("sql_text").alias("text"))
    files = corpus.file_contents(entries).select(F.lit("sql_file_entry").alias("table_name"), F.col("path").alias("record_key"), F.col("content").alias("text"))
    return states.unionByName(files)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with characters that arose from decoding with the wrong encoding."""
    return mojibake.find_garbled(_texts(spark, d))[0]


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(_texts(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document's text by byte_bpe_50k."""
    return tokens.encode(spread(load(spark, d, "documents")), "text", ["doc_id"], tokens.tokenizer_file())


def _mixed(spark: SparkSession, d: str):
    documents, targets = load(spark, d, "documents", "mix_target")
    sizes = tokens.encode(spread(documents), "text", ["doc_id", "source"], tokens.tokenizer_file(), count_only=True)
    return mixing.mix(sizes, targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their repeats."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are not equal character by character."""
    pairs = lookalike.lookalike_pairs(spread(load(spark, d, "documents")), "text", "doc_id")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document that looks like a different one: its class and the class's size."""
    return lookalike.lookalike_classes(spread(load(spark, d, "documents")), "text", "doc_id")


def p9_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unified(load(spark, d, "documents"), "text", ["doc_id"])


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_faults": p2_faults,
    "p2_rates": p2_rates,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_unified": p9_unified,
}

_STATES = """s AS (SELECT * FROM (SELECT regexp_replace(replace(trim(source_id), chr(92), '/'), '^(\\./)+', '') AS sid, *,
 row_number() OVER (PARTITION BY regexp_replace(replace(trim(source_id), chr(92), '/'), '^(\\./)+', '') ORDER BY committed_at DESC NULLS LAST, sql_text DESC) AS rn FROM sql_source) WHERE rn = 1)"""

_PAIRS = f"""{_STATES}, w AS (SELECT sid, regexp_extract_all(lower(sql_text), '[a-z0-9_]+') AS w FROM s WHERE sql_text IS NOT NULL),
sh AS (SELECT sid, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) > 2),
t AS (SELECT sid, unnest(g) AS g FROM sh), c AS (SELECT sid, len(g) AS n FROM sh),
b AS (SELECT x.sid AS a, y.sid AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.sid < y.sid GROUP BY 1, 2),
pair AS MATERIALIZED (SELECT a, b FROM b JOIN c ca ON ca.sid = a JOIN c cb ON cb.sid = b WHERE k >= 0.7 * (ca.n + cb.n - k))"""

ORACLES = {
    "p1_found": f"WITH {_PAIRS} SELECT a AS source_id_a, b AS source_id_b FROM pair",
    "p1_groups": f"""WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
r(x, y) AS (SELECT sid, sid FROM s WHERE sid <> '' UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS source_id, min(y) AS group_id FROM r GROUP BY x""",
}
