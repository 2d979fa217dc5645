"""Traces to a dataset: classify, give a reason for each exclusion, keep first copies, split by groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.functions.hashing import check_fractions, hash_split, nul_joined_key
from sievetrace.functions.text import PLACEHOLDER_STATE
from sievetrace.schema import NEXT_ACTION
from sievetrace.sources.jsonl import ORDER

BACKENDS = ("mock", "lean-cli", "leandojo")


@dataclass(frozen=True)
class Filters:
    """Which rows a dataset includes."""

    backends: tuple[str, ...] = ("lean-cli", "leandojo")
    allow_mock: bool = False
    include_failed: bool = False
    include_finished: bool = True
    most_tactic_chars: int | None = None
    most_state_chars: int | None = None
    dedup: bool = True


@dataclass(frozen=True)
class Splits:
    """Fractions and seed of the group split."""

    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    seed: int = 42

    def __post_init__(self) -> None:
        check_fractions(self.train, self.val, self.test)


def quality(backend: Column, state_after: Column) -> Column:
    """How far a row's verification can be trusted; null if it can't be told."""
    b = F.lower(F.coalesce(backend, F.lit("")))
    unreal = state_after.isNull() | (state_after == PLACEHOLDER_STATE)
    return F.when((b == "leandojo") & ~unreal, "real").when(b == "lean-cli", "theorem-level").when(b == "mock", "mock")


def exclusion(f: Filters) -> Column:
    """The first reason that excludes a row, or null; copies are told apart later."""
    b = F.lower(F.coalesce("backend", F.lit("")))
    shown = F.when(b == "", "<empty>").otherwise(b)
    kind = quality(F.col("backend"), F.col("state_after"))
    over = lambda c, most: F.length(F.coalesce(c, F.lit(""))) > most if most is not None else F.lit(False)
    return (
        F.when(~b.isin(*BACKENDS), F.concat(F.lit("unknown_backend:"), shown))
        .when(~b.isin(*f.backends), "backend_filter")
        .when(kind.isNull(), "unverifiable_classification")
        .when((kind == "mock") & ~F.lit(f.allow_mock), "mock_disallowed")
        .when(~F.col("success") & ~F.lit(f.include_failed), "failed_excluded")
        .when(F.col("proof_finished") & ~F.lit(f.include_finished), "proof_finished_excluded")
        .when(over("tactic", f.most_tactic_chars), "tactic_too_long")
        .when(over("state_before", f.most_state_chars), "state_too_long")
    )


def keep_first(rows: DataFrame, fingerprint: str, order: tuple[str, ...] = ORDER, only: Column | None = None) -> DataFrame:
    """``_copy``: whether an earlier row, in the given order, has the same fingerprint; among rows that ``only`` holds for.

    The first row's order is a partial aggregate joined back, so copies are combined before the shuffle and a
    fingerprint with a third of all rows isn't sorted in one task.
    """
    own = only if only is not None else F.lit(True)
    at = F.struct(*order)
    firsts = rows.filter(own).groupBy(fingerprint).agg(F.min(at).alias("_first"))
    return rows.join(firsts, fingerprint, "left").withColumn("_copy", F.coalesce(own & (at > F.col("_first")), F.lit(False))).drop("_first")


def classify(traces: DataFrame, f: Filters = Filters(), s: Splits = Splits()) -> DataFrame:
    """Traces with ``reason`` (null: included), verification_quality, split, source_record_hash and state_after_is_real."""
    valid = F.col("_valid") if "_valid" in traces.columns else F.lit(True)
    rows = traces.withColumn("reason", F.when(~valid, "invalid").otherwise(exclusion(f)))
    rows = rows.withColumn("source_record_hash", nul_joined_key(F.col("theorem_name"), F.col("state_before"), F.col("tactic")))
    if f.dedup:
        rows = keep_first(rows, "source_record_hash", only=F.col("reason").isNull())
        rows = rows.withColumn("reason", F.when(F.col("_copy"), "duplicate").otherwise(F.col("reason"))).drop("_copy")
    kind = quality(F.col("backend"), F.col("state_after"))
    return rows.withColumns({
        "verification_quality": kind,
        "split": hash_split(F.col("theorem_name"), s.seed, s.train, s.val, s.test),
        "state_after_is_real": F.coalesce((kind == "real") & F.col("state_after").isNotNull(), F.lit(False)),
    })


def included(classified: DataFrame) -> DataFrame:
    """The dataset's 14 columns and its order."""
    return classified.filter("reason is null").select(*ORDER, *NEXT_ACTION)


def reasons(classified: DataFrame) -> DataFrame:
    """(reason, n) of the excluded rows."""
    return classified.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def split_members(dataset: DataFrame) -> DataFrame:
    """(split, theorem_name) of included rows, each once."""
    return dataset.select("split", "theorem_name").distinct()


def summary(classified: DataFrame) -> DataFrame:
    """One row: rows read, invalid, included, distinct groups and actions, rows and groups by split.

    Distinct groups are counted from one row for each group, distinct actions from their digests.
    """
    inc = F.col("reason").isNull()
    of = lambda s: inc & (F.col("split") == s)
    splits = ("train", "val", "test")
    rows = classified.agg(
        F.count("*").alias("records_read"), F.count_if(F.col("reason") == "invalid").alias("records_invalid"), F.count_if(inc).alias("records_included"),
        *(F.count_if(of(s)).alias(f"rows_{s}") for s in splits),
    )
    included_rows = classified.filter(inc)
    groups = included_rows.groupBy("theorem_name").agg(F.collect_set("split").alias("splits"))  # three splits at most
    told = groups.agg(F.count("theorem_name").alias("unique_theorems"), *(F.count_if(F.array_contains("splits", s) & F.col("theorem_name").isNotNull()).alias(f"groups_{s}") for s in splits))
    actions = included_rows.select(F.md5("tactic").alias("_tactic")).agg(F.countDistinct("_tactic").alias("unique_tactics"))
    return rows.join(F.broadcast(told)).join(F.broadcast(actions))  # one row each


def counts(classified: DataFrame, col: str) -> DataFrame:
    """(value, n) over included rows; raw values."""
    return classified.filter("reason is null").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def write(classified: DataFrame, path: str, s: Splits = Splits()) -> None:
    """The four artifacts, written even when they are empty: rows, splits, distinct actions, summary and reasons."""
    from sievetrace.sources.jsonl import distinct_text, to_json

    rows = included(classified)
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/next_tactic")
    split_members(rows).withColumn("seed", F.lit(s.seed)).write.mode("overwrite").parquet(f"{path}/theorem_splits")
    distinct_text(rows, "tactic").repartitionByRange("raw").sortWithinPartitions("raw").select("line").write.mode("overwrite").text(f"{path}/plain_tactics")
    to_json(summary(classified)).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    to_json(reasons(classified)).coalesce(1).write.mode("overwrite").text(f"{path}/reasons")


def examples(dataset: DataFrame) -> DataFrame:
    """The columns that rankers learn from; successes only where the dataset tells."""
    rows = dataset.filter("success") if "success" in dataset.columns else dataset
    return rows.select("theorem_name", "theorem_statement", "state_before", "tactic", "split", *(c for c in ORDER if c in rows.columns))


def train_and_eval(dataset: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows; ValueError if a group is in both."""
    train, held = dataset.filter("split = 'train'"), dataset.filter(F.col("split") == split)
    if split != "train":
        leaked = held.select("theorem_name").join(train.select("theorem_name"), "theorem_name", "left_semi").distinct()
        if names := [r[0] for r in leaked.limit(5).collect()]:
            raise ValueError(f"leakage: {names} are in train and {split}")
    return train, held


def nth(partition: str, *order: Column) -> Column:
    """Row number within a key."""
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))
