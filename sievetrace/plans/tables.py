"""The driver's tables, and documents and events read as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces: the source is the theorem and tells the backend, the text is the action."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    m = F.col("doc_id") % 7
    return docs.select(
        F.col("source").alias("theorem_name"), F.col("lang").alias("theorem_statement"), F.col("lang").alias("state_before"), F.col("text").alias("tactic"),
        F.when(m == 1, F.lit("<verified by lean-cli>")).when(m != 0, F.col("lang")).alias("state_after"),
        (F.col("doc_id") % 5 != 0).alias("success"), (F.col("doc_id") % 3 == 0).alias("proof_finished"),
        F.when(number == 0, "LeanDojo").when(number == 1, "mock").when(number == 2, "other").otherwise("lean-cli").alias("backend"),
        F.lit(1).alias("num_goals_before"), F.lit(None).cast("int").alias("num_goals_after"),
        F.lit(0).alias("_file_ord"), F.col("doc_id").alias("_line_no"),
    )


#: The same in SQL.
DOCUMENT_TRACES = """tr AS (
  SELECT source AS theorem_name, lang AS theorem_statement, lang AS state_before, text AS tactic,
    CASE WHEN doc_id % 7 = 1 THEN '<verified by lean-cli>' WHEN doc_id % 7 <> 0 THEN lang END AS state_after,
    doc_id % 5 <> 0 AS success, doc_id % 3 = 0 AS proof_finished,
    CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 5 WHEN 0 THEN 'LeanDojo' WHEN 1 THEN 'mock' WHEN 2 THEN 'other' ELSE 'lean-cli' END AS backend,
    doc_id AS line_no FROM documents),
rsn AS (
  SELECT *, CASE WHEN lower(backend) NOT IN ('mock', 'lean-cli', 'leandojo') THEN 'unknown_backend:' || lower(backend)
    WHEN lower(backend) = 'leandojo' AND (state_after IS NULL OR state_after = '<verified by lean-cli>') THEN 'unverifiable_classification'
    WHEN lower(backend) = 'mock' THEN 'mock_disallowed' WHEN NOT success THEN 'failed_excluded' WHEN length(tactic) > 20000 THEN 'tactic_too_long' END AS early,
    sha256(theorem_name || chr(0) || state_before || chr(0) || tactic) AS fingerprint,
    CASE WHEN lower(backend) = 'leandojo' THEN 'real' WHEN lower(backend) = 'lean-cli' THEN 'theorem-level' ELSE 'mock' END AS quality,
    CAST(('0x' || substr(sha256(theorem_name || '|42'), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS u FROM tr),
cls AS (
  SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, fingerprint ORDER BY line_no) > 1 THEN 'duplicate' ELSE early END AS reason,
    CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM rsn)"""


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: the user is the theorem, the event type the action, properties the state."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("theorem_name"), F.col("props").alias("state_before"), F.col("event_type").alias("tactic"),
        F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", F.lit("<verified by lean-cli>")).alias("state_after"),
        (F.col("event_type") != "error").alias("success"), (F.col("event_type") == "purchase").alias("proof_finished"), (F.col("value") > 20).alias("state_changed"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3).cast("int")).alias("num_goals_before"), F.when(F.col("event_id") % 3 != 0, F.lit(1)).alias("num_goals_after"),
        (F.col("value") > 90).alias("timeout"), F.lit("mock").alias("model"), F.when(F.col("event_id") % 2 == 0, "mock").alias("backend"),
        F.lit(0).alias("_file_ord"), F.col("event_id").alias("_line_no"), "ts",
    )


EVENT_TRACES = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS theorem_name, props AS state_before, event_type AS tactic,
    CASE WHEN event_type = 'click' THEN props WHEN event_type = 'view' THEN '<verified by lean-cli>' END AS state_after,
    event_type <> 'error' AS success, event_type = 'purchase' AS proof_finished, value > 20 AS state_changed,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 3 END AS num_goals_before, CASE WHEN event_id % 3 <> 0 THEN 1 END AS num_goals_after,
    value > 90 AS timeout, 'mock' AS model, CASE WHEN event_id % 2 = 0 THEN 'mock' END AS backend, event_id AS line_no, ts FROM events)"""
