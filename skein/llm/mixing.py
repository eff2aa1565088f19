"""Mixing sources to target weights, in tokens, with capped repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.chunked import number_rows
from skein.runtime import materialize

SEED = 17


def source_key(c: str):
    """Outer blanks dropped, lower case; null and blank sources are one group, ''."""
    return F.coalesce(F.lower(F.btrim(F.col(c), F.lit(" \t"))), F.lit(""))


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix and its shares, from (doc_id, source, n_tokens) and (source, target_share, max_repeats).

    Each source has a budget of target_share x total_tokens (default: the tokens
    of all documents). Documents of a source get hash-random keys, are sorted by
    them and summed; the source is used ``epochs`` whole times, then up to the
    document with which the running sum still fits the rest of the budget. No
    document is used more than max_repeats times, so a source that is too small
    falls short; the shortfall is reported, not given to others. Sources without
    a target are used 0 times, targets without documents appear with 0 tokens.
    A null max_repeats counts as 1, a null target_share as 0; of several targets
    of a source the greatest values count.
    Documents of 0 tokens go along with their place in the order.

    Returns (doc_id, source, n_tokens, repeats) with repeats > 0, and per source
    the budget, tokens and shares reached.
    """
    rows = materialize(sizes.select("doc_id", source_key("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "sizes")
    per = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    if total_tokens is None:
        total_tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0  # one number
    goals = targets.groupBy(source_key("source").alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    budget = F.floor(F.coalesce("target_share", F.lit(0.0)) * F.lit(total_tokens)).cast("long")
    plan = goals.join(per, "source", "full").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        budget.alias("budget"),
    )
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.coalesce("max_repeats", F.lit(0)))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole)
    rest = F.when(F.col("epochs") < F.coalesce("max_repeats", F.lit(0)), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)
    plan = materialize(plan.withColumn("rest", rest.cast("long")), "mix-plan")

    keyed = rows.withColumn("_at", F.xxhash64("doc_id", F.lit(seed)))
    ordered = number_rows(keyed, "source", ["_at", "doc_id"], sums=["n_tokens"], label="mix")
    # The number of sources is that of the target table and the source names: the size is checked.
    small = plan.select("source", "epochs", "rest")
    used = ordered.join(small, "source").withColumn(
        "repeats", (F.col("epochs") + ((F.col("rest") > 0) & (F.col("_run_n_tokens") <= F.col("rest"))).cast("long"))
    )
    used = materialize(used.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), "mixed")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.sum("repeats").alias("document_uses"))
    all_used = used.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0
    report = plan.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "tokens",
        "budget",
        "epochs",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("document_uses", F.lit(0)).alias("document_uses"),
        (F.coalesce("tokens_used", F.lit(0)) / F.lit(max(total_tokens, 1))).alias("share_of_total"),
        (F.coalesce("tokens_used", F.lit(0)) / F.lit(max(all_used, 1))).alias("share_of_mix"),
    )
    return used, report
