"""Audit, summary and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions.hashing import hash_split
from sievetrace.functions.text import head, preview
from sievetrace.operators import audit, summary
from sievetrace.plans.registry import query
from sievetrace.plans.tables import EVENT_TRACES, event_traces, table
from sievetrace.streaming import traces as streams

_RATE = "count(*) AS attempts, count(*) FILTER (success) AS successes, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS success_rate"
_UNIT = "CAST(('0x' || substr(sha256({} || '|42'), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0"
_FAMILIES = f"""f AS (SELECT DISTINCT source AS theorem_name, CASE WHEN length(source) > 4 THEN 'two_digits' ELSE 'one_digit' END AS family FROM documents),
s AS (SELECT theorem_name, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT theorem_name, {_UNIT.format("theorem_name")} AS u FROM f))"""


def _families(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = table(spark, d, "documents").select(F.col("source").alias("theorem_name")).distinct()
    return names.withColumn("family", F.when(F.length("theorem_name") > 4, "two_digits").otherwise("one_digit")), names.withColumn("split", hash_split(F.col("theorem_name")))


@query("audit_group_rates", f"WITH {EVENT_TRACES} SELECT theorem_name AS name, {_RATE} FROM ev GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_theorem(event_traces(spark, d))


@query("audit_zero_success", f"WITH {EVENT_TRACES} SELECT theorem_name || '@' || strftime(ts, '%Y-%m-%d %H') AS name, {_RATE} FROM ev GROUP BY 1 HAVING count(*) FILTER (success) = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("theorem_name", F.lit("@"), F.date_format("ts", "yyyy-MM-dd HH"))
    return audit.never(audit.rates(event_traces(spark, d), key, F.col("success")))


@query(
    "audit_head_rates",
    f"""WITH h AS (SELECT role = 'assistant' AS success, regexp_replace(regexp_extract(text, '^\\s*\\(*\\s*(\\S+)', 1), '[,;]+$', '') AS head FROM conversations)
SELECT coalesce(nullif(head, ''), '<empty>') AS name, {_RATE} FROM h GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("text").alias("tactic"), (F.col("role") == "assistant").alias("success"))
    return audit.by_head(turns)


@query(
    "audit_duplicates",
    "SELECT sha256(text) AS fingerprint, count(*) AS n, CASE WHEN length(any_value(text)) > 60 THEN substr(any_value(text), 1, 60) || '...' ELSE any_value(text) END AS preview FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, min(doc_id) LIMIT 20",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), preview(F.col("text")).alias("shown"), F.lit(0).alias("_file_ord"), F.col("doc_id").alias("_line_no"))
    return audit.duplicates(docs, ["fingerprint", "shown"], "shown", 20).select("fingerprint", "n", F.col("shown").alias("preview"))


@query(
    "audit_top_errors",
    "SELECT regexp_replace(url, '^.*?://[^/]*\\.example\\.([a-z]+)/([a-z]+)/.*$', 'error: \\1/\\2') AS error, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, min(page_id) LIMIT 10",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("url", r"^.*?://[^/]*\.example\.([a-z]+)/([a-z]+)/.*$", "error: $1/$2\nmore")
    pages = table(spark, d, "pages").select(F.concat(F.lit("/tmp/attempt_x1.lean:2:8: "), text).alias("error"), F.lit(False).alias("success"), F.lit(0).alias("_file_ord"), F.col("page_id").alias("_line_no"))
    return audit.top_errors(pages, 10)


@query(
    "audit_family_pivot",
    f"""WITH {_FAMILIES}, t AS (SELECT source AS theorem_name, coalesce(quality = 1, false) AS success FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT family, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM f JOIN s USING (theorem_name) GROUP BY family)
SELECT family, {_RATE}, count(DISTINCT theorem_name) AS theorems, any_value(train) AS train, any_value(val) AS val, any_value(test) AS test FROM t JOIN f USING (theorem_name) JOIN p USING (family) GROUP BY family""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("theorem_name")).join(table(spark, d, "labels"), "doc_id", "left").withColumn("success", F.col("quality") == 1)
    families, splits = _families(spark, d)
    return audit.by_family(rows, families, splits)


@query(
    "audit_coverage_warnings",
    f"""WITH {_FAMILIES}, g AS (SELECT theorem_name, theorem_name AS family FROM f),
p AS (SELECT family, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split <> 'train') AS held FROM g JOIN s USING (theorem_name) GROUP BY family)
SELECT 'only_train' AS kind, family AS subject, 'family ''' || family || ''' is only in train (' || train || '), never evaluated' AS warning FROM p WHERE train > 0 AND held = 0
UNION ALL SELECT 'only_eval', family, 'family ''' || family || ''' is only evaluated (' || held || '), never trained' FROM p WHERE train = 0 AND held > 0
UNION ALL SELECT 'no_relative', theorem_name, 'theorem ''' || theorem_name || ''' (family ''' || family || ''') has no relative in train' FROM g JOIN s USING (theorem_name) JOIN p USING (family) WHERE split <> 'train' AND train = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    families, splits = _families(spark, d)
    return audit.coverage(families.withColumn("family", F.col("theorem_name")), splits)


@query(
    "summary_overall",
    f"""WITH {EVENT_TRACES}, h AS (SELECT *, tactic IN ('click', 'view') AS auto FROM ev),
a AS (SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (proof_finished) AS finished, count(*) FILTER (success AND proof_finished) AS finished_hits,
  count(*) FILTER (success AND state_changed) AS changed, count(*) FILTER (timeout) AS timeouts,
  CAST(sum(coalesce(num_goals_before, 0)) FILTER (success) AS DOUBLE) / count(*) FILTER (success) AS avg_goals_before,
  CAST(sum(coalesce(num_goals_after, 0)) FILTER (success) AS DOUBLE) / count(*) FILTER (success) AS avg_goals_after,
  count(DISTINCT theorem_name) AS unique_theorems, count(DISTINCT tactic) AS unique_tactics, count(DISTINCT state_before) AS unique_states_before, count(DISTINCT state_after) AS unique_states_after,
  count(*) FILTER (success) - count(DISTINCT CASE WHEN success THEN state_before || chr(0) || tactic END) AS duplicates FROM h)
SELECT total, successful, finished, timeouts, duplicates, avg_goals_before, avg_goals_after, unique_theorems, unique_tactics, unique_states_before, unique_states_after,
  CAST(successful AS DOUBLE) / total AS success_rate, CAST(finished AS DOUBLE) / total AS proof_completion_rate, CAST(finished_hits AS DOUBLE) / successful AS proof_finished_ratio,
  CAST(changed AS DOUBLE) / successful AS state_changed_rate, CAST(duplicates AS DOUBLE) / successful AS duplicate_rate FROM a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarise(event_traces(spark, d)).select(
        "total", "successful", "finished", "timeouts", "duplicates", "avg_goals_before", "avg_goals_after", "unique_theorems", "unique_tactics", "unique_states_before", "unique_states_after",
        "success_rate", "proof_completion_rate", "proof_finished_ratio", "state_changed_rate", "duplicate_rate",
    )


@query("summary_distribution", f"WITH {EVENT_TRACES} SELECT coalesce(backend, 'None') AS value, count(*) AS n FROM ev GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return summary.distribution(event_traces(spark, d), F.col("backend"))


@query("summary_dup_pairs", f"WITH {EVENT_TRACES} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM ev GROUP BY theorem_name, tactic)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return summary.duplicate_pairs(event_traces(spark, d), ["theorem_name", "tactic"])


@query("summary_json_field", "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total_k, round(avg(CAST(props ->> '$.k' AS DOUBLE)), 6) AS avg_k FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total_k"), F.round(F.avg("k"), 6).alias("avg_k"))


@query(
    "warnings_flags",
    f"""WITH {EVENT_TRACES}, a AS (SELECT theorem_name, count(*) AS n, count(*) FILTER (success) AS s, count(*) FILTER (success AND tactic IN ('click')) AS auto, count(DISTINCT CASE WHEN success THEN state_before || chr(0) || tactic END) AS k,
  bool_and(CASE WHEN success THEN coalesce(state_after = '<verified by lean-cli>', false) END) AS p FROM ev GROUP BY theorem_name)
SELECT theorem_name, coalesce(CAST(auto AS DOUBLE) / nullif(s, 0), 0) >= 0.6 AS high_automation, coalesce(CAST(s - k AS DOUBLE) / nullif(s, 0), 0) >= 0.3 AS high_duplicates, coalesce(p, false) AS all_placeholder FROM a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ev = event_traces(spark, d).withColumn("tactic", F.when(F.col("tactic") == "click", "simp").otherwise(F.col("tactic")))
    said = summary.summarise(ev, by=("theorem_name",))
    has = lambda part, name: F.exists("warnings", lambda w: w.startswith(part)).alias(name)
    return said.select("theorem_name", has("high automation", "high_automation"), has("high duplicate", "high_duplicates"), has("all successes", "all_placeholder"))


@query("topk_first_seen", f"WITH {EVENT_TRACES} SELECT theorem_name AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, min(line_no) LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return summary.most_common(event_traces(spark, d), F.col("theorem_name"), 10)


@query("top_heads", "SELECT regexp_replace(regexp_extract(text, '^\\s*\\(*\\s*(\\S+)', 1), '[,;]+$', '') AS value, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, min(conv_id * 100000 + turn) LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'").select(head(F.col("text")).alias("h"), F.lit(0).alias("_file_ord"), (F.col("conv_id") * 100000 + F.col("turn")).alias("_line_no"))
    return summary.most_common(turns, F.col("h"), 20)


@query("stream_window_rate", f"WITH {EVENT_TRACES} SELECT date_trunc('hour', ts) AS window_start, tactic, {_RATE.replace('(success)', '(theorem_name <> chr(48))')} FROM ev GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_rates(event_traces(spark, d), "ts", "tactic", F.col("theorem_name") != "0")
