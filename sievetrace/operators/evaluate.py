"""Verified evaluation: each distinct prediction is checked once, through the memory of verdicts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import ratio
from sievetrace.operators import lookup, metrics
from sievetrace.operators.verify import check_all, check_sources, example_source


class Evaluation(NamedTuple):
    """What an evaluation finds; families and confused are None without families."""

    predictions: DataFrame
    metrics: DataFrame
    failures: DataFrame
    families: DataFrame | None
    confused: DataFrame | None


def example_checker(checker: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """Checks actions on bare statements as whole files, for ``check_all``."""

    def run(rows: DataFrame) -> DataFrame:
        return check_sources(rows.withColumn("source", example_source(F.col("theorem_statement"), F.col("tactic"))), "source", checker)

    return run


def checked(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], memory: str) -> DataFrame:
    """A verdict for each distinct (theorem_name, theorem_statement, tactic) of the rows' predictions."""
    each = rows.select("theorem_name", "theorem_statement", F.explode("predictions").alias("tactic")).distinct()
    return check_all(each, verify, memory)


def evaluate(
    rows: DataFrame, examples: DataFrame, verify: Callable[[DataFrame], DataFrame], memory: str, ks: tuple[int, ...] = metrics.KS, families: DataFrame | None = None, actions: DataFrame | None = None
) -> Evaluation:
    """Predictions (row_id, theorem_name, theorem_statement, state_before, ground_truth_tactic, predictions) with the
    actions that examples verify and those that ``verify`` accepts, their metrics, failures, and rates by family.

    ``families`` has (theorem_name, family), ``actions`` (tactic, families) of known actions for the confusion.
    """
    verdicts = checked(rows, verify, memory)
    per = verdicts.filter("success").groupBy("theorem_name").agg(F.collect_set("tactic").alias("accepted"))  # at most the actions that were predicted for it
    flagged = lookup.with_verified(rows, lookup.verified_sets(examples)).join(per, "theorem_name", "left")
    flagged = metrics.flags(flagged.withColumn("accepted", F.coalesce("accepted", F.array().cast("array<string>"))), ks, "accepted")
    checks = flagged.agg(
        F.coalesce(F.sum(F.size(F.array_distinct("predictions"))), F.lit(0)).alias("checks"), F.coalesce(F.sum(F.size(F.array_intersect("predictions", "accepted"))), F.lit(0)).alias("verified_checks")
    )
    told = metrics.metrics(flagged, ks).join(F.broadcast(checks)).withColumn("verified_rate", ratio(F.col("verified_checks"), F.col("checks")))  # one row each
    by = metrics.by_family(flagged, families, ks) if families is not None else None
    confused = None
    if families is not None and actions is not None:
        first = flagged.select("theorem_name", F.get("predictions", F.lit(0)).alias("top1")).join(families.withColumnRenamed("family", "true_family"), "theorem_name")
        confused = metrics.confusion(lookup.unique_family(first, actions, "top1"))
    return Evaluation(flagged, told, metrics.failures(rows, verdicts), by, confused)


def offline(rows: DataFrame, k: int = 5) -> DataFrame:
    """One row about a generator's predictions without a verifier: first and any exact, distinct texts, distinct for each row."""
    truth = F.col("ground_truth_tactic")
    rate = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    distinct = F.size(F.array_distinct("predictions"))
    own = rows.agg(F.count("*").alias("n"), rate(metrics.top1_exact(F.col("predictions"), truth), "top1_exact"), rate(F.array_contains(F.slice("predictions", 1, k), truth), f"top{k}_contains"), rate(distinct, "avg_distinct"))
    texts = rows.select(F.explode("predictions").alias("tactic")).agg(F.countDistinct("tactic").alias("unique_predictions"))
    return own.join(F.broadcast(texts))  # one row each
