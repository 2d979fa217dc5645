"""Trace summaries: one row of counts and rates, distributions, warnings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import ratio
from sievetrace.functions.text import PLACEHOLDER_STATE, head, is_automation
from sievetrace.sources.jsonl import ORDER

HIGH_AUTOMATION, HIGH_DUPLICATES = 0.6, 0.3


def distinct_with_null(c: Column) -> Column:
    """Distinct values, null being one."""
    return F.countDistinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def duplicate_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of their keys, nulls being values."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def summarise(traces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The summary as one row, or one for each value of ``by``; rates of an empty table are 0.

    Distinct values are counted on digests, one count at a time: each is a distinct aggregation of its own with a
    map-side step, so no row is copied for the others and no text is shuffled.
    """
    hit = F.coalesce("success", F.lit(False))
    of_hit = lambda c: F.count_if(hit & F.coalesce(F.col(c), F.lit(False)))
    counts = traces.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("successful"), F.count_if(F.coalesce("proof_finished", F.lit(False))).alias("finished"),
        of_hit("proof_finished").alias("finished_hits"), of_hit("state_changed").alias("changed"), F.count_if(F.coalesce("timeout", F.lit(False))).alias("timeouts"),
        ratio(F.sum(F.when(hit, F.coalesce("num_goals_before", F.lit(0)))), F.count_if(hit)).alias("avg_goals_before"),
        ratio(F.sum(F.when(hit, F.coalesce("num_goals_after", F.lit(0)))), F.count_if(hit)).alias("avg_goals_after"),
        F.count_if(hit & is_automation(F.col("tactic"))).alias("automation"),
        F.coalesce(F.bool_and(F.coalesce("model", F.lit("None")) == "mock"), F.lit(True)).alias("all_mock_model"),
        F.coalesce(F.bool_and(F.coalesce("backend", F.lit("None")) == "mock"), F.lit(True)).alias("all_mock_backend"),
        (F.coalesce(F.bool_and(F.when(hit, F.coalesce(F.col("state_after") == PLACEHOLDER_STATE, F.lit(False)))), F.lit(False))).alias("all_placeholder"),
    )
    pair = F.when(hit, F.concat(digest(F.col("state_before")), digest(F.col("tactic"))))
    distinct = {  # a null is a value of the first three
        "unique_theorems": digest(F.col("theorem_name")), "unique_tactics": digest(F.col("tactic")), "unique_states_before": digest(F.col("state_before")),
        "unique_states_after": F.when(F.length("state_after") > 0, digest(F.col("state_after"))), "_pairs": pair,
    }
    base = counts
    for name, value in distinct.items():
        own = traces.select(*by, value.alias("_value")).groupBy(*by).agg(F.countDistinct("_value").alias(name))
        if not by:
            base = base.join(F.broadcast(own))  # one row each
            continue
        own = own.select(*(F.col(c).alias(f"_{c}") for c in by), name)
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))  # a null is a group, too
        base = base.join(own, same).drop(*(f"_{c}" for c in by))
    base = base.withColumn("duplicates", F.col("successful") - F.col("_pairs")).drop("_pairs")
    over = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    rated = base.select(
        "*", over("successful", "total", "success_rate"), over("finished", "total", "proof_completion_rate"), over("finished_hits", "successful", "proof_finished_ratio"),
        over("changed", "successful", "state_changed_rate"), over("duplicates", "successful", "duplicate_rate"), over("automation", "successful", "automation_tactic_ratio"),
    )
    return rated.withColumn("warnings", warnings())


def digest(c: Column) -> Column:
    """A 128-bit digest of a value, null being a value of its own."""
    return F.coalesce(F.unhex(F.md5(c.cast("string"))), F.lit(b"null"))


def warnings() -> Column:
    """Array of what a reader of a summary must know."""
    empty = F.col("total") == 0
    cases = (
        (empty, "no records"),
        (~empty & (F.col("all_mock_model") | F.col("all_mock_backend")), "all records come from a mock; nothing was verified"),
        (F.col("automation_tactic_ratio") >= HIGH_AUTOMATION, "high automation ratio"),
        (F.col("duplicate_rate") >= HIGH_DUPLICATES, "high duplicate rate"),
        (F.col("all_placeholder"), "all successes were verified as whole files, without intermediate states"),
    )
    return F.filter(F.array(*(F.when(c, text) for c, text in cases)), lambda x: x.isNotNull())


def distribution(rows: DataFrame, value: Column) -> DataFrame:
    """(value, n); null counts as the value ``None``."""
    return rows.groupBy(F.coalesce(value.cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, value: Column, n: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The ``n`` most frequent values; ties by their first row."""
    groups = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return groups.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def top_heads(traces: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent heads of successful actions."""
    return most_common(traces.filter("success"), head(F.col("tactic")), n)
