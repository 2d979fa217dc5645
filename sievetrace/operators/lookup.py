"""Joins: prioritised proposals, verified actions by state, verdict memory, novelty and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.sources.jsonl import ORDER


def prioritised(asked: DataFrame, proposals: DataFrame, most: int | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``asked`` with the proposals for its (theorem_name, state): the first row of that state, else the name's only row, else none."""
    at = F.struct(*order)
    given = proposals.select("theorem_name", F.col("state_before").alias("state"), "candidates", *(c for c in ("source", "prompt_style") if c in proposals.columns), at.alias("_at"))
    rest = [c for c in given.columns if c not in ("theorem_name", "state", "_at")]
    exact = given.groupBy("theorem_name", "state").agg(F.min_by(F.struct(*rest), "_at").alias("_exact"))
    only = given.groupBy("theorem_name").agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_only")).filter("_n = 1").drop("_n")
    out = asked.join(exact, ["theorem_name", "state"], "left").join(only, "theorem_name", "left")
    found = F.coalesce("_exact", "_only")
    out = out.withColumn("_found", found).select(*asked.columns, *(F.col(f"_found.{c}").alias(c) for c in rest))
    actions = F.coalesce("candidates", F.array().cast("array<string>"))
    return out.withColumn("candidates", F.slice(actions, 1, most) if most else actions)


def verified_sets(rows: DataFrame, keys: tuple[str, ...] = ("theorem_name", "state_before"), value: str = "tactic") -> DataFrame:
    """Sorted distinct values by key."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("verified"))


def with_verified(rows: DataFrame, sets: DataFrame, keys: tuple[str, ...] = ("theorem_name", "state_before")) -> DataFrame:
    """Rows with their key's set, an empty one where there is none."""
    return rows.join(sets, list(keys), "left").withColumn("verified", F.coalesce("verified", F.array().cast("array<string>")))


def unique_family(rows: DataFrame, families: DataFrame, action: str, other: str = "<ambiguous/other>") -> DataFrame:
    """``predicted_family``: an action's family if it has just one."""
    single = families.filter(F.size("families") == 1).select(F.col("tactic").alias(action), F.get("families", F.lit(0)).alias("predicted_family"))
    return rows.join(single, action, "left").withColumn("predicted_family", F.coalesce("predicted_family", F.lit(other)))


def unknown(asked: DataFrame, known: DataFrame, key: str = "cache_key") -> DataFrame:
    """Distinct rows whose key isn't known."""
    return asked.join(known.select(key), key, "left_anti").dropDuplicates([key])


def novel(rows: DataFrame, seen: DataFrame, col: str) -> DataFrame:
    """Rows whose value isn't seen."""
    return rows.join(seen.select(col).distinct(), col, "left_anti")


def shared(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values of both tables."""
    return a.select(col).intersect(b.select(col))


def ranked(rows: DataFrame, key: str, n: int, *order: F.Column) -> DataFrame:
    """The first ``n`` rows of each key with their rank; the filter lets Spark limit groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
