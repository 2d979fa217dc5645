"""Lookup, verification, collection and stream queries."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievetrace.operators import collect, evaluate, lookup, metrics, verify
from sievetrace.plans.registry import query
from sievetrace.plans.tables import table
from sievetrace.sources import jsonl
from sievetrace.sources.working import folder
from sievetrace.streaming import traces as streams


@query(
    "lookup_priority",
    """WITH p AS (SELECT conv_id AS name, role AS state, text, turn FROM conversations), a AS (SELECT DISTINCT conv_id AS name, 'assistant' AS state FROM conversations),
x AS (SELECT name, state, arg_min(text, turn) AS text FROM p GROUP BY ALL), o AS (SELECT name, any_value(text) AS text FROM p GROUP BY name HAVING count(*) = 1)
SELECT a.name AS theorem_name, coalesce(x.text, o.text) AS candidate FROM a LEFT JOIN x USING (name, state) LEFT JOIN o USING (name)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    given = turns.select(F.col("conv_id").alias("theorem_name"), F.col("role").alias("state_before"), F.array("text").alias("candidates"), F.lit(0).alias("_file_ord"), F.col("turn").alias("_line_no"))
    asked = turns.select(F.col("conv_id").alias("theorem_name"), F.lit("assistant").alias("state")).distinct()
    return lookup.prioritised(asked, given, 1).select("theorem_name", F.get("candidates", F.lit(0)).alias("candidate"))


@query("oracle_sets", "SELECT user_id, props, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS verified FROM events WHERE event_type <> 'error' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type <> 'error'")
    return lookup.verified_sets(rows, ("user_id", "props"), "event_type").select("user_id", "props", F.array_join("verified", ",").alias("verified"))


@query(
    "verdict_cache_misses",
    """WITH k AS (SELECT sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type || chr(0) || CAST(CAST(round(value) AS INT) AS VARCHAR)) AS cache_key, ts FROM events)
SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE ts < TIMESTAMP '2024-01-10')""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    action = F.concat("event_type", F.lit("\0"), F.round("value").cast("int"))
    rows = table(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("theorem_name"), action.alias("tactic")).withColumn("cache_key", verify.verdict_key())
    return lookup.unknown(rows.select("cache_key"), rows.filter("ts < timestamp '2024-01-10'"))


_MOCK = """CASE WHEN head IN ('rfl', 'decide', 'trivial', 'omega', 'norm_num') OR head = 'simp' AND len(blocks) <= 1 THEN 'no goals'
  WHEN head = 'simp' THEN array_to_string(blocks[1:len(blocks) - 1], chr(10) || chr(10)) WHEN head IN ('intro', 'intros') THEN text || chr(10) || 'h : _' END"""


@query(
    "mock_verify",
    f"""WITH c AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'rfl' WHEN 1 THEN 'intro h' WHEN 2 THEN 'simp' ELSE 'exact h' END AS tactic FROM conversations),
h AS (SELECT *, split_part(tactic, ' ', 1) AS head, list_filter(string_split(text, chr(10) || chr(10)), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS blocks FROM c)
SELECT conv_id, turn, {_MOCK} AS next_state, coalesce({_MOCK} = 'no goals', false) AS proof_finished, CASE WHEN {_MOCK} IS NULL THEN 'mock: unknown tactic ''' || head || '''' END AS error FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 4
    tactic = F.when(m == 0, "rfl").when(m == 1, "intro h").when(m == 2, "simp").otherwise("exact h")
    rows = table(spark, d, "conversations").select("conv_id", "turn", verify.mock_verdict(F.col("text"), tactic).alias("r"))
    return rows.select("conv_id", "turn", "r.next_state", "r.proof_finished", "r.error")


@query(
    "collect_mock",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, unnest(['trivial', 'rfl', 'exact h', 'sorry', 'intro x', 'rfl']) AS tactic FROM s), d AS (SELECT DISTINCT conv_id, tactic FROM c WHERE tactic <> 'sorry')
SELECT tactic, count(*) AS attempted, count(*) FILTER (tactic <> 'exact h') AS succeeded, count(*) FILTER (tactic IN ('trivial', 'rfl')) AS finished FROM d GROUP BY tactic""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("theorem_name")).distinct()
    seeds = names.select("theorem_name", F.lit("True").alias("theorem_statement"), F.lit("").alias("initial_state"))
    offers = names.select("theorem_name", F.lit("⊢ True").alias("state_before"), F.array(*map(F.lit, ("trivial", "rfl", "exact h", "sorry", "intro x", "rfl"))).alias("candidates"), F.lit("file").alias("source"), F.lit("x").alias("prompt_style"), F.lit(0).alias("_file_ord"), F.lit(0).alias("_line_no"))
    traces = collect.collect(seeds, offers)
    return traces.groupBy("tactic").agg(F.count("*").alias("attempted"), F.count_if("success").alias("succeeded"), F.count_if("proof_finished").alias("finished"))


_START = "CASE conv_id % 3 WHEN 0 THEN '⊢ ∀ x, p' WHEN 1 THEN '⊢ → q' ELSE '⊢ r' END"


@query(
    "state_expand",
    f"""WITH RECURSIVE x AS (SELECT DISTINCT conv_id, {_START} AS state, 0 AS step_index, CAST(NULL AS VARCHAR) AS parent FROM conversations UNION ALL
  SELECT conv_id, CASE WHEN starts_with(state, '⊢ ∀') OR starts_with(state, '⊢ →') THEN '⊢' || substr(state, 4) ELSE state || chr(10) || 'h : _' END, step_index + 1, substr(sha1(state), 1, 16) FROM x WHERE step_index < 3),
t AS (SELECT x.*, unnest(['intro h', 'rfl', 'exact h']) AS tactic FROM x)
SELECT conv_id, step_index, state AS state_before, parent AS parent_state_hash, tactic, tactic <> 'exact h' AS success, tactic = 'rfl' AS proof_finished FROM t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "conversations").select("conv_id").distinct()
    m = F.col("conv_id") % 3
    seeds = names.select(F.col("conv_id").cast("string").alias("theorem_name"), F.lit("p").alias("theorem_statement"), F.when(m == 0, "⊢ ∀ x, p").when(m == 1, "⊢ → q").otherwise("⊢ r").alias("initial_state"))
    offered = F.array(*map(F.lit, ("intro h", "rfl", "exact h")))
    offers = names.select(F.col("conv_id").cast("string").alias("theorem_name"), F.lit("any").alias("state_before"), offered.alias("candidates"), F.lit("file").alias("source"), F.lit("x").alias("prompt_style"), F.lit(0).alias("_file_ord"), F.lit(0).alias("_line_no"))
    traces = collect.collect(seeds, offers, depth=4)
    return traces.select(F.col("theorem_name").cast("bigint").alias("conv_id"), "step_index", "state_before", "parent_state_hash", "tactic", "success", "proof_finished")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of the files that they are in."""
    kept = table(spark, d, "events")
    return streams.read(spark, f"{d}/events.parque[t]", kept.schema).withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern: the path of a stream must be a folder else


def _gathered(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for everything that is there."""
    path = folder(spark)
    streams.run_all(stream, lambda df, n: df.write.mode("append").parquet(f"{path}/rows"), f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, streams.drop_copies(_streamed(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "400 days")).select("user_id", "event_type")


@query(
    "stream_rates",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS attempts, count(*) FILTER (value > 20) AS successes, CAST(count(*) FILTER (value > 20) AS DOUBLE) / count(*) AS success_rate FROM events GROUP BY 1, 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rates = _gathered(spark, streams.windowed_rates(_streamed(spark, d), "ts", "event_type", F.col("value") > 20), "update")
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_routed", "SELECT event_type <> 'error' AS success, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    streams.write_routed(_streamed(spark, d).withColumn("success", F.col("event_type") != "error"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return jsonl.read_routed(spark, f"{path}/rows").groupBy("success", "event_type").agg(F.count("*").alias("n"))


# -- verifiers


class _Counter:
    """A backend whose states are numbers: ``+`` adds one, ``=`` finishes at 3 or more, anything else fails."""

    def start(self, theorem: dict) -> SimpleNamespace:
        return SimpleNamespace(pp="⊢ 0", n=0)

    def run(self, state: SimpleNamespace, action: str) -> SimpleNamespace:
        if action == "+":
            return SimpleNamespace(pp=f"⊢ {state.n + 1}", n=state.n + 1)
        return SimpleNamespace(finished=True) if action == "=" and state.n >= 3 else SimpleNamespace(error=f"no {action}")


@query(
    "session_verify",
    """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, CASE WHEN turn % 7 = 6 THEN '?' WHEN turn % 5 = 4 THEN '=' ELSE '+' END AS tactic FROM conversations),
s AS (SELECT *, CASE WHEN k < 2 THEN k ELSE 9 END AS n, count(*) FILTER (tactic = '+' AND k < 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT conv_id, turn, CASE WHEN (n = 0 OR n = 1 AND seen >= 1) AND tactic = '+' THEN '⊢ ' || (n + 1) END AS next_state, false AS proof_finished,
  CASE WHEN NOT (n = 0 OR n = 1 AND seen >= 1) THEN 'unknown state' WHEN tactic <> '+' THEN 'no ' || tactic END AS error FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    tactic = F.when(F.col("turn") % 7 == 6, "?").when(F.col("turn") % 5 == 4, "=").otherwise("+")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("theorem_name"), F.concat(F.lit("⊢ "), F.when(k < 2, k).otherwise(9)).alias("state"), tactic.alias("tactic"))
    done = verify.run_sessions(rows, lambda: verify.Live(_Counter()), 60.0, "turn")
    return done.select("conv_id", "turn", "next_state", "proof_finished", "error")


@query(
    "subprocess_verify",
    "SELECT item_id, t.tactic, contains(text || t.tactic, 'hath') AS success, CASE WHEN NOT contains(text || t.tactic, 'hath') THEN 'exit code 1' END AS error FROM benchmark, (SELECT unnest(['rfl', 'exact hath']) AS tactic) t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(F.lit("rfl"), F.lit("exact hath"))).alias("tactic"))
    rows = rows.withColumn("source", verify.example_source(F.col("text"), F.col("tactic")))
    return verify.check_sources(rows, "source", verify.Subprocess(["grep", "-q", "hath"]).check).select("item_id", "tactic", "success", "error")


_LOOKUP = "(user_id * 7 + length(tactic)) % 3 = 0"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first eight event types as the predictions of a row."""
    first = lookup.ranked(table(spark, d, "events"), "user_id", 8, F.col("event_id"))
    rows = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda s: s["event_type"]).alias("predictions"), F.max_by("event_type", "event_id").alias("ground_truth_tactic"))  # 8 for each
    name = F.col("user_id").cast("string").alias("theorem_name")
    return rows.select(F.col("user_id").alias("row_id"), name, F.lit("p").alias("theorem_statement"), F.lit("s").alias("state_before"), "ground_truth_tactic", "predictions")


def _by_lookup(rows: DataFrame) -> DataFrame:
    """A verifier that is a rule over a table: each asked action's verdict."""
    ok = (F.col("theorem_name").cast("bigint") * 7 + F.length("tactic")) % 3 == 0
    return rows.withColumns({"success": ok, "error": F.when(~ok, F.concat(F.lit("no "), "tactic")), "elapsed_ms": F.lit(0.0)})


_PREDICTED = f"""p AS (SELECT user_id, event_type AS tactic, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id FROM events),
w AS (SELECT user_id, tactic, rank FROM p WHERE rank <= 8), truth AS (SELECT user_id, arg_max(tactic, event_id) AS truth FROM (SELECT * FROM p WHERE rank <= 8) GROUP BY user_id),
u AS (SELECT user_id, tactic, {_LOOKUP} AS ok, row_number() OVER (PARTITION BY user_id ORDER BY min(rank)) AS place FROM w GROUP BY user_id, tactic)"""


def _evaluated(spark: SparkSession, d: str) -> evaluate.Evaluation:
    rows = _predicted(spark, d)
    every = rows.select("theorem_name", "state_before", F.col("ground_truth_tactic").alias("tactic"))
    families = rows.select("theorem_name", F.when(F.col("row_id") % 2 == 0, "eq_refl").otherwise("eq_symm").alias("family"))
    actions = spark.createDataFrame([("click", ["eq_refl"]), ("view", ["eq_symm"]), ("error", ["eq_refl", "eq_symm"])], "tactic string, families array<string>")
    return evaluate.evaluate(rows, every, _by_lookup, folder(spark), families=families, actions=actions)


@query(
    "evaluate_verified",
    f"""WITH {_PREDICTED}, f AS (SELECT user_id, bool_or(ok AND place <= 1) AS p1, bool_or(ok AND place <= 3) AS p3, bool_or(ok AND place <= 5) AS p5, count(*) AS checks, count(*) FILTER (ok) AS good FROM u GROUP BY user_id)
SELECT count(*) AS n, avg(p1::INT) AS pass_at_1, avg(p3::INT) AS pass_at_3, avg(p5::INT) AS pass_at_5, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(good) AS BIGINT) AS verified_checks, sum(good) / sum(checks) AS verified_rate FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).metrics.select("n", "pass_at_1", "pass_at_3", "pass_at_5", "checks", "verified_checks", "verified_rate")


@query("evaluate_failures", f"WITH {_PREDICTED} SELECT user_id AS row_id, tactic, 'no ' || tactic AS error FROM u WHERE NOT ok")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).failures.select("row_id", "tactic", "error")


@query(
    "evaluate_families",
    f"""WITH {_PREDICTED}, f AS (SELECT user_id, bool_or(ok AND place <= 1) AS p1, bool_or(ok AND place <= 5) AS p5 FROM u GROUP BY user_id)
SELECT CASE WHEN user_id % 2 = 0 THEN 'eq_refl' ELSE 'eq_symm' END AS family, count(*) AS n_rows, avg(p1::INT) AS pass_at_1, avg(p5::INT) AS pass_at_5, count(*) FILTER (p5) AS passed_5 FROM f GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).families.select("family", "n_rows", "pass_at_1", "pass_at_5", "passed_5")


@query(
    "evaluate_accuracy",
    f"""WITH {_PREDICTED}, c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'eq_refl' ELSE 'eq_symm' END AS truth, CASE tactic WHEN 'click' THEN 'eq_refl' WHEN 'view' THEN 'eq_symm' ELSE '<ambiguous/other>' END AS said FROM w WHERE rank = 1)
SELECT 'eq' AS "group", count(*) AS n, CAST(count(*) FILTER (truth = said) AS DOUBLE) / count(*) AS accuracy FROM c""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_accuracy(_evaluated(spark, d).confused)


@query(
    "verdict_memory",
    f"""WITH w AS (SELECT DISTINCT user_id, event_type AS tactic FROM events), v AS (SELECT user_id, tactic, {_LOOKUP} AS ok, tactic = 'error' AS late FROM w)
SELECT sha256(CAST(user_id AS VARCHAR) || chr(0) || tactic) AS cache_key, ok AND NOT late AS success, CASE WHEN late THEN 'timeout' WHEN NOT ok THEN 'no ' || tactic END AS error, NOT late AS remembered FROM v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("theorem_name"), F.lit("p").alias("theorem_statement"), F.col("event_type").alias("tactic"))
    late = F.col("tactic") == "error"
    slow = lambda asked: _by_lookup(asked).withColumns({"success": F.col("success") & ~late, "error": F.when(late, "timeout").otherwise(F.col("error"))})
    path = folder(spark)
    verify.check_all(rows.filter("tactic <> 'view'"), slow, path)
    again = verify.check_all(rows, slow, path).select("cache_key", "success", "error").distinct()
    kept = verify.remembered(spark, path).select("cache_key", F.lit(True).alias("remembered"))
    return again.join(kept, "cache_key", "left").withColumn("remembered", F.coalesce("remembered", F.lit(False)))
