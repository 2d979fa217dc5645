"""Corpus audit: rates by group and head, duplicates, errors, families by split, coverage warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import ratio
from sievetrace.functions.text import head, normalise_error, preview
from sievetrace.sources.jsonl import ORDER


def _hit(success: Column) -> Column:
    return F.coalesce(success, F.lit(False))


def rates(rows: DataFrame, key: Column, success: Column, unknown: str = "<unknown>") -> DataFrame:
    """(name, attempts, successes, success_rate); null and empty names are ``unknown``."""
    name = F.coalesce(F.nullif(key, F.lit("")), F.lit(unknown))
    out = rows.groupBy(name.alias("name")).agg(F.count("*").alias("attempts"), F.count_if(_hit(success)).alias("successes"))
    return out.withColumn("success_rate", ratio(F.col("successes"), F.col("attempts")))


def by_theorem(traces: DataFrame) -> DataFrame:
    """Rates by theorem."""
    return rates(traces, F.col("theorem_name"), F.col("success"))


def never(rates: DataFrame) -> DataFrame:
    """Groups without a success."""
    return rates.filter("successes = 0")


def by_head(traces: DataFrame) -> DataFrame:
    """Rates by an action's head."""
    return rates(traces, head(F.col("tactic")), F.col("success"), "<empty>")


def duplicates(rows: DataFrame, keys: list[str], shown: str, n: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The ``n`` most frequent groups of several rows, with a preview; ties by first row."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first")).filter("n > 1")
    return groups.orderBy(F.desc("n"), "_first").limit(n).withColumn("preview", preview(F.col(shown))).drop("_first")


def top_errors(traces: DataFrame, n: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The ``n`` most frequent normalised errors of failures; ties by first row."""
    failed = traces.filter(~_hit(F.col("success"))).select(normalise_error(F.col("error")).alias("error"), *order).filter(F.length("error") > 0)
    groups = failed.groupBy("error").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return groups.orderBy(F.desc("n"), "_first").limit(n).select("error", "n")


def by_family(traces: DataFrame, families: DataFrame, splits: DataFrame) -> DataFrame:
    """Attempts, successes, rate and theorems of each family, and its theorems by split (of all its theorems)."""
    tried = traces.join(families, "theorem_name").groupBy("family").agg(
        F.count("*").alias("attempts"), F.count_if(_hit(F.col("success"))).alias("successes"), F.countDistinct("theorem_name").alias("theorems")
    )
    return tried.withColumn("success_rate", ratio(F.col("successes"), F.col("attempts"))).join(family_splits(families, splits), "family", "left").na.fill(0, ["train", "val", "test"])


def family_splits(families: DataFrame, splits: DataFrame) -> DataFrame:
    """Distinct theorems of each family by split."""
    rows = families.join(splits, "theorem_name", "left")
    return rows.groupBy("family").pivot("split", ["train", "val", "test"]).agg(F.countDistinct("theorem_name")).na.fill(0)


def coverage(families: DataFrame, splits: DataFrame) -> DataFrame:
    """(kind, subject, warning): families only trained or only evaluated, evaluated theorems without a trained relative."""
    by = family_splits(families, splits)
    held = F.col("val") + F.col("test")
    only_train = by.filter((F.col("train") > 0) & (held == 0)).select(F.lit("only_train").alias("kind"), F.col("family").alias("subject"), F.format_string("family '%s' is only in train (%d), never evaluated", "family", "train").alias("warning"))
    only_eval = by.filter((F.col("train") == 0) & (held > 0)).select(F.lit("only_eval"), "family", F.format_string("family '%s' is only evaluated (%d), never trained", "family", held))
    alone = families.join(splits, "theorem_name").filter("split in ('val', 'test')").join(by.filter("train > 0"), "family", "left_anti")
    alone = alone.select(F.lit("no_relative"), "theorem_name", F.format_string("theorem '%s' (family '%s') has no relative in train", "theorem_name", "family"))
    return only_train.union(only_eval).union(alone)
