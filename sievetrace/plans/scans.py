"""Queries over files that are written first: scans, sinks and artifacts, and generators in workers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.operators import dataset, generate
from sievetrace.plans.datasets import SPLIT_SQL, UNIT_SQL, classified
from sievetrace.plans.registry import query
from sievetrace.plans.tables import DOCUMENT_TRACES, table
from sievetrace.sources import jsonl, proposers
from sievetrace.sources.working import folder


def _one_file(rows: DataFrame, order: str, line: str) -> str:
    """A folder with one file of the rows' lines, in order."""
    path = folder(rows.sparkSession)
    rows.orderBy(order).coalesce(1).select(F.col(line).alias("value")).write.text(path)
    return f"{path}/part-*"


# -- scans


@query(
    "scan_traces",
    """WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS line_no FROM events)
SELECT line_no, CASE WHEN event_id % 10 <> 0 THEN 'e' || event_id END AS theorem_name, event_id % 10 NOT IN (0, 3, 4) AS valid, 'llm' AS source, false AS timeout, CASE WHEN event_id % 10 NOT IN (0, 4) THEN event_type END AS tactic FROM e WHERE event_id % 10 NOT IN (1, 2)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 10
    name = F.concat(F.lit("e"), "event_id")
    fields = [name.alias("theorem_name"), F.lit("s").alias("theorem_statement"), F.lit("⊢ p").alias("state_before"), F.when(m != 4, F.col("event_type")).alias("tactic"), F.lit(True).alias("success"), F.lit(False).alias("proof_finished")]
    whole = F.to_json(F.struct(*fields, F.lit(None).cast("string").alias("state_after"), F.lit(1).alias("unknown_key")), {"ignoreNullFields": "false"})
    line = F.when(m == 0, "{broken").when(m == 1, " # a comment").when(m == 2, "  ").when(m == 3, F.to_json(F.struct(*fields))).otherwise(F.concat(F.lit("  "), whole, F.lit("\t")))
    path = _one_file(table(spark, d, "events").select("event_id", line.alias("line")), "event_id", "line")
    rows = jsonl.traces(spark, jsonl.expand(spark, [path]))
    return rows.select(F.col("_line_no").alias("line_no"), "theorem_name", F.col("_valid").alias("valid"), "source", "timeout", "tactic")


_SEEDED = "SELECT conv_id, turn, role, 't' || conv_id AS name, row_number() OVER (ORDER BY conv_id * 1000 + turn) AS line_no FROM conversations"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Turns as seeds, read from a file: the role is the family, a few actions are expected; some have a key too many."""
    turns = table(spark, d, "conversations")
    wanted = F.array(F.concat(F.lit("act"), F.col("turn") % 3), F.concat(F.lit("do"), "role"))
    meta = F.struct(F.col("role").alias("pattern_family"), wanted.alias("expected_success_tactics"))
    fields = [F.concat(F.lit("t"), "conv_id").alias("theorem_name"), F.lit("p").alias("theorem_statement"), meta.alias("metadata")]
    line = F.when(F.col("turn") == 3, F.to_json(F.struct(*fields, F.lit(1).alias("surprise")))).otherwise(F.to_json(F.struct(*fields)))
    return jsonl.seeds(spark, _one_file(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), line.alias("line")), "at", "line"))


@query("scan_seed_families", f"SELECT name AS theorem_name, arg_max(role, line_no) AS family FROM ({_SEEDED}) WHERE turn <> 3 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.families(_seeds(spark, d))


@query(
    "scan_action_families",
    f"SELECT tactic, string_agg(DISTINCT role, ',' ORDER BY role) AS families FROM (SELECT role, unnest(['act' || (turn % 3), 'do' || role]) AS tactic FROM ({_SEEDED}) WHERE turn <> 3) GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.families_of_actions(_seeds(spark, d)).select("tactic", F.array_join("families", ",").alias("families"))


@query("scan_seeds_first", f"SELECT line_no, name AS theorem_name, '__TACTIC__' AS placeholder, CAST(0 AS INT) AS n_imports FROM ({_SEEDED}) WHERE turn <> 3 ORDER BY line_no LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    whole = F.to_json(F.struct(F.concat(F.lit("t"), "conv_id").alias("theorem_name"), F.lit("p").alias("theorem_statement")))
    line = F.when(F.col("turn") == 3, "{}").otherwise(whole)
    path = _one_file(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), line.alias("line")), "at", "line")
    return jsonl.seeds(spark, path, 25).select(F.col("_line_no").alias("line_no"), "theorem_name", "placeholder", F.size("imports").alias("n_imports"))


@query("scan_candidates", "SELECT 't' || conv_id AS theorem_name, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN turn % 2 = 0 THEN 'file' ELSE 'manual-file' END AS source, count(*) AS rows FROM conversations GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    even = F.col("turn") % 2 == 0
    name = F.concat(F.lit("t"), "conv_id").alias("theorem_name")
    line = F.when(even, F.to_json(F.struct(name, F.lit("s").alias("state_before"), F.array(F.lit("a"), F.lit("b")).alias("candidates"), F.lit("file").alias("source")))).otherwise(F.to_json(F.struct(name)))
    path = _one_file(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), line.alias("line")), "at", "line")
    rows = proposers.source("Manual_File")(turns, path)
    return rows.groupBy("theorem_name", F.size("candidates").alias("n"), "source").agg(F.count("*").alias("rows"))


_SPLITS = f"SELECT DISTINCT source AS theorem_name, {SPLIT_SQL} AS split FROM (SELECT source, {UNIT_SQL.format('source')} FROM documents)"


@query("scan_splits", _SPLITS)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("theorem_name"), dataset.hash_split(F.col("source")).alias("split"))
    named = dataset.split_members(rows).groupBy().pivot("split", ["train", "val", "test"]).agg(F.collect_list("theorem_name"))  # a splits file is one object
    path = f"{folder(spark)}/splits"
    named.select(F.to_json(F.struct("train", "val", "test")).alias("value")).coalesce(1).write.text(path)
    return jsonl.splits(spark, f"{path}/part-*")


# -- sinks


@query("sink_counts", "SELECT 'write' AS sink, count(*) AS told, count(*) AS found FROM benchmark UNION ALL SELECT 'append', count(*), 2 * count(*) FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, path = table(spark, d, "benchmark"), folder(spark)
    told = [("write", jsonl.write(rows, path), spark.read.text(path).count())]
    told.append(("append", jsonl.append(rows, path), spark.read.text(path).count()))
    return spark.createDataFrame(told, "sink string, told bigint, found bigint")


@query(
    "dataset_artifacts",
    f"""WITH {DOCUMENT_TRACES}, i AS (SELECT * FROM cls WHERE reason IS NULL)
SELECT 'rows_' || split AS artifact, count(*) AS n FROM i GROUP BY split UNION ALL SELECT 'splits', count(DISTINCT theorem_name) FROM i UNION ALL SELECT 'plain_tactics', count(DISTINCT tactic) FROM i
UNION ALL SELECT 'summary_included', count(*) FROM i UNION ALL SELECT 'reasons', count(DISTINCT reason) FROM cls WHERE reason IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    dataset.write(classified(spark, d), path)
    count = lambda df, name: df.agg(F.lit(name).alias("artifact"), F.count("*").alias("n"))
    rows = spark.read.parquet(f"{path}/next_tactic").groupBy(F.concat(F.lit("rows_"), "split").alias("artifact")).agg(F.count("*").alias("n"))
    told = spark.read.json(f"{path}/summary").select(F.lit("summary_included").alias("artifact"), F.col("records_included").alias("n"))
    return rows.union(count(spark.read.parquet(f"{path}/theorem_splits"), "splits")).union(count(spark.read.text(f"{path}/plain_tactics"), "plain_tactics")).union(told).union(count(spark.read.json(f"{path}/reasons"), "reasons"))


@query("skeleton_rows", "SELECT DISTINCT 't' || conv_id AS theorem_name, role AS state_before, 0 AS n FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "conversations").select(F.concat(F.lit("t"), "conv_id").alias("theorem_name"), F.col("role").alias("initial_state")).distinct()
    path = folder(spark)
    jsonl.write(jsonl.skeleton(seeds), path)
    return jsonl.candidates(spark, f"{path}/part-*").select("theorem_name", "state_before", F.size("candidates").alias("n"))


@query(
    "model_artifacts",
    """SELECT 'char ' || char AS name, CAST(row_number() OVER (ORDER BY char) + 3 AS DOUBLE) AS value FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''
UNION ALL SELECT 'mean ' || dim, round(avg(x), 5) FROM (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    generate.save(path, generate.vocabulary(table(spark, d, "benchmark"), "text"), generate.latent_statistics(table(spark, d, "embeddings"), "embedding"))
    ids, latents = generate.load(spark, path)
    rows = [(f"char {c}", float(k)) for c, k in ids.items()] + [(f"mean {k}", mean) for k, (mean, _) in enumerate(latents)]
    return spark.createDataFrame(rows, "name string, value double").withColumn("value", F.round("value", 5))


@query(
    "hosted_memory",
    """WITH r AS (SELECT conv_id, turn, role || ': ' || turn % 3 AS state FROM conversations) SELECT conv_id, turn, md5(state) AS raw_output, turn % 3 = 0 AS known FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    state = F.concat("role", F.lit(": "), F.col("turn") % 3)
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.lit("t").alias("theorem_name"), F.lit("p").alias("theorem_statement"), state.alias("state"))
    call = lambda request: hashlib.md5(request.split("proof state:\n")[1].split("\n")[0].encode()).hexdigest()
    none = spark.createDataFrame([], "cache_key string, raw_output string")
    first = folder(spark)
    proposers.hosted(turns.filter("turn % 3 = 0"), call, none, "m", 3)[1].write.parquet(first)
    known = spark.read.parquet(first)
    out, _ = proposers.hosted(turns, proposers.retried(call, 1), known, "m", 3)
    return out.join(known.select("cache_key", F.lit(True).alias("known")), "cache_key", "left").select("conv_id", "turn", "raw_output", F.coalesce("known", F.lit(False)).alias("known"))


# -- generators


class _Speller:
    """A generator that says its prompt's first three letters: a state is (place, ids of them, end)."""

    def __init__(self) -> None:
        self.ids = {chr(97 + k): 4 + k for k in range(26)}
        self.chars = {k: c for c, k in self.ids.items()}

    def start(self, prompt: str) -> np.ndarray:
        return np.array([0, *[self.ids[c] for c in prompt if c in self.ids][:3], *[generate.END] * 4][:5])

    def step(self, states: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        log_p = np.full((len(states), 30), -9.0)
        place = np.minimum(states[:, 0] + 1, 4)
        log_p[np.arange(len(states)), states[np.arange(len(states)), place]] = -0.01
        states = states.copy()
        states[:, 0] += 1
        return states, log_p

    def __call__(self, prompt: str) -> list[str]:
        found = generate.beam(self, prompt, self.chars, 3, 6)
        return [generate.greedy(self, prompt, self.chars, 6), found[0][0], str(len(found))]


@query("decode_prompts", "SELECT event_id, substr(event_type, 1, 3) AS greedy, substr(event_type, 1, 3) AS best FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type").distinct()
    said = generate.predict(rows, "event_type", _Speller).select("event_type", F.get("predictions", F.lit(0)).alias("greedy"), F.get("predictions", F.lit(1)).alias("best"))
    return table(spark, d, "events").select("event_id", "event_type").join(F.broadcast(said), "event_type").select("event_id", "greedy", "best")  # a few event types


class _Flow:
    """Samples that one step brings to a corner that the prompt names, read as the nearest of three texts."""

    texts = ["zero", "one", "two"]

    def __call__(self, prompt: str) -> list[str]:
        goal = np.eye(3)[int(prompt) % 3] * 2
        found = generate.sample(prompt, lambda z, t: goal - z, lambda z: generate.snap(z, np.eye(3), self.texts), 16, 3, 1)
        return [f"{text}:{n}" for text, n in found]


@query("flow_samples", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END || ':16' AS samples FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("prompt"))
    return generate.predict(rows, "prompt", _Flow).select("item_id", F.array_join("predictions", ",").alias("samples"))
