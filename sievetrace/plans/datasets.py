"""Dataset queries over documents read as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions.hashing import hash_split
from sievetrace.operators import dataset, lookup
from sievetrace.plans.registry import query
from sievetrace.plans.tables import DOCUMENT_TRACES, document_traces, table
from sievetrace.sources.jsonl import distinct_text

FILTERS = dataset.Filters(backends=("lean-cli", "leandojo", "mock"), most_tactic_chars=20_000)
SPLIT_SQL = "CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"
UNIT_SQL = "CAST(('0x' || substr(sha256({} || '|42'), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS u"


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Documents with reasons and splits."""
    return dataset.classify(document_traces(spark, d), FILTERS)


@query("dataset_build", f"WITH {DOCUMENT_TRACES} SELECT split, count(*) AS n_rows, count(DISTINCT theorem_name) AS n_groups FROM cls WHERE reason IS NULL GROUP BY split")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.included(classified(spark, d))
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("theorem_name").alias("n_groups"))


@query("dataset_build_reasons", f"WITH {DOCUMENT_TRACES} SELECT reason, count(*) AS n FROM cls WHERE reason IS NOT NULL GROUP BY reason")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.reasons(classified(spark, d))


@query("dataset_rows", f"WITH {DOCUMENT_TRACES} SELECT line_no AS doc_id, split, quality AS verification_quality, fingerprint AS source_record_hash, quality = 'real' AS state_after_is_real FROM cls WHERE reason IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.included(classified(spark, d)).select(F.col("_line_no").alias("doc_id"), "split", "verification_quality", "source_record_hash", "state_after_is_real")


@query(
    "dataset_summary",
    f"""WITH {DOCUMENT_TRACES} SELECT count(*) AS records_read, CAST(0 AS BIGINT) AS records_invalid, count(*) FILTER (reason IS NULL) AS records_included,
  count(DISTINCT theorem_name) FILTER (reason IS NULL) AS unique_theorems, count(DISTINCT tactic) FILTER (reason IS NULL) AS unique_tactics,
  count(*) FILTER (reason IS NULL AND split = 'train') AS rows_train, count(DISTINCT theorem_name) FILTER (reason IS NULL AND split = 'train') AS groups_train,
  count(*) FILTER (reason IS NULL AND split = 'val') AS rows_val, count(DISTINCT theorem_name) FILTER (reason IS NULL AND split = 'val') AS groups_val,
  count(*) FILTER (reason IS NULL AND split = 'test') AS rows_test, count(DISTINCT theorem_name) FILTER (reason IS NULL AND split = 'test') AS groups_test FROM cls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.summary(classified(spark, d))


@query("dataset_backend_counts", f"WITH {DOCUMENT_TRACES} SELECT backend AS value, count(*) AS n FROM cls WHERE reason IS NULL GROUP BY backend")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.counts(classified(spark, d), "backend")


@query("dataset_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return dataset.keep_first(docs, "fingerprint", ("doc_id",)).filter("not _copy").select("doc_id")


@query("dataset_hash_split", f"SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, count(DISTINCT source) AS n_groups FROM (SELECT source, {UNIT_SQL.format('source')} FROM documents) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", hash_split(F.col("source")).alias("split"))
    return docs.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_groups"))


@query("dataset_split_members", f"SELECT DISTINCT split, source AS theorem_name FROM (SELECT source, {SPLIT_SQL} AS split FROM (SELECT source, {UNIT_SQL.format('source')} FROM documents))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_members(table(spark, d, "documents").select(F.col("source").alias("theorem_name"), hash_split(F.col("source")).alias("split")))


@query("dataset_distinct_sorted", "SELECT DISTINCT replace(text, chr(10), '\\n') AS line FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    return distinct_text(table(spark, d, "conversations"), "text").select("line")


@query(
    "novelty_anti",
    f"WITH c AS (SELECT text, {SPLIT_SQL} AS split FROM (SELECT text, {UNIT_SQL.format('source')} FROM documents)) SELECT split, count(*) AS n FROM c WHERE split <> 'train' AND text NOT IN (SELECT text FROM c WHERE split = 'train') GROUP BY split",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("fingerprint"), hash_split(F.col("source")).alias("split"))
    return lookup.novel(docs.filter("split <> 'train'"), docs.filter("split = 'train'"), "fingerprint").groupBy("split").agg(F.count("*").alias("n"))


@query(
    "leak_intersection",
    f"WITH c AS (SELECT text, {SPLIT_SQL} AS split FROM (SELECT text, {UNIT_SQL.format('source')} FROM documents)) SELECT sha256(text) AS fingerprint FROM c WHERE split = 'train' INTERSECT SELECT sha256(text) FROM c WHERE split <> 'train'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("fingerprint"), hash_split(F.col("source")).alias("split"))
    return lookup.shared(docs.filter("split = 'train'"), docs.filter("split <> 'train'"), "fingerprint")
