"""Corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``docs``:

1. quality rules: documents that their own rules or their host's verdict reject go;
2. n-gram Jaccard join: one document of each class of near duplicates stays;
3. substring dedup: passages of 50 words or more that a document with a smaller id has too are cut;
4. secret scans: secrets are masked;
5. packing: the pieces of all documents in token sequences.

A stage starts by deleting the working tables of those before it, which its written input no longer needs.
Where a stage changes the text, ``n_chars`` follows.  No stage drops a row for another reason; a document
whose text is cut to nothing stays as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.llm import jaccard, packing, quality, secrets, substring
from sievetrace.llm.runtime import recorded, release, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _alone(place: int) -> Callable[[Stage], Stage]:
    """A stage, by its place, that first deletes the working tables of earlier ones, but what its input reads or is older than."""

    def of(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(docs, place)
            with recorded(place):
                return stage(spark, docs, sf_dir)

        return run

    return of


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_alone(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own and their host's rules."""
    return quality.keep_good(docs)


@_alone(1)
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_first(docs)


@_alone(2)
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has too."""
    return _counted(substring.dedup(docs, out="what went").select(*(F.col(f"`{c}`") for c in docs.columns)))


@_alone(3)
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return _counted(secrets.redact(docs))


@_alone(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: SQL can't express MinHash pruning, the forest or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else table(docs), sf_dir)
    return docs
