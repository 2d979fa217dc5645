"""Queries over single parts: text and key functions, arithmetic, selection, small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions import arithmetic, hashing, text
from sievetrace.operators import collect, dataset, evaluate, generate, lookup, metrics, rank, summary, verify
from sievetrace.plans.registry import query
from sievetrace.plans.tables import EVENT_TRACES, event_traces, table
from sievetrace.sources import jsonl, proposers

_D = "CAST(embedding AS DOUBLE[])"

# -- text


@query(
    "split_raw_output",
    r"""WITH m AS (SELECT doc_id, '```lean' || chr(10) || replace(replace(text, '. ', chr(10)), ', ', chr(10) || ' ' || chr(10)) || chr(10) || '  ```' || chr(10) || '/- a' || chr(10) || 'b -/' AS raw FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '(?s)/-.*?-/', '', 'g'), '(?m)^[ \t]*```.*$', '', 'g') AS t FROM m),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS lines, list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS blocks FROM c)
SELECT doc_id, CAST(len(lines) AS INT) AS n_lines, CAST(len(blocks) AS INT) AS n_blocks, md5(array_to_string(lines, '|')) AS lines, md5(array_to_string(blocks, '|')) AS blocks FROM l""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    body = F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\n \n"))
    raw = F.concat(F.lit("```lean\n"), body, F.lit("\n  ```\n/- a\nb -/"))
    rows = table(spark, d, "documents").select("doc_id", text.split_proposals(raw).alias("l"), text.split_proposals(raw, blocks=True).alias("b"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.size("b").alias("n_blocks"), F.md5(F.array_join("l", "|")).alias("lines"), F.md5(F.array_join("b", "|")).alias("blocks"))


@query(
    "sanitize_raw",
    r"""WITH l AS (SELECT conv_id, turn, unnest(string_split('1. ' || replace(text, '. ', chr(10) || '- ') || chr(10) || 'sorry' || chr(10) || '`rfl`' || chr(10) || 'rfl -- again', chr(10))) AS x FROM conversations),
c AS (SELECT conv_id, turn, trim(trim(regexp_replace(regexp_replace(regexp_replace(x, '\s*--.*$', ''), '^\s*\d+[.)]\s+', ''), '^\s*[-*+]\s+', '')), '`') AS x FROM l),
g AS (SELECT conv_id, turn, x, count(*) AS n, regexp_matches(lower(x), '\b(sorry|admit|unsafe)\b') AS bad FROM c WHERE x <> '' GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(n) AS INT) AS clean, CAST(sum(n - 1) AS INT) AS duplicates, CAST(count(*) FILTER (bad) AS INT) AS forbidden, CAST(count(*) FILTER (NOT bad) AS INT) AS kept FROM g GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("\n- ")), F.lit("\nsorry\n`rfl`\nrfl -- again"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.clean_candidates(text.split_proposals(raw)).alias("c"))
    return rows.select("conv_id", "turn", "c.clean", "c.duplicates", "c.forbidden", F.size("c.kept").alias("kept"))


@query("automation_share", "SELECT theorem_name, count(*) FILTER (head IN ('simp', 'omega', 'ring')) AS automated, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS theorem_name, CASE event_type WHEN 'click' THEN 'simp' WHEN 'view' THEN 'omega' WHEN 'error' THEN 'ring' ELSE event_type END AS head FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "  (simp only [h])").when(kind == "view", "omega, done").when(kind == "error", "ring;").otherwise(F.concat(kind, F.lit(" simp")))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("theorem_name"), text.is_automation(action).alias("auto"))
    return rows.groupBy("theorem_name").agg(F.count_if("auto").alias("automated"), F.count("*").alias("n"))


@query("goal_count_marks", "SELECT doc_id, CASE WHEN text <> '' THEN CAST(greatest(1, len(string_split(text, 'th')) - 1) AS INT) END AS n_goals FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.count_turnstiles(F.replace("text", F.lit("th"), F.lit("⊢"))).cast("int").alias("n_goals"))


@query("backend_names", "SELECT source, lower(replace(source, 'src', 'lean-')) AS backend, count(*) AS n FROM documents GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.lit("  "), F.replace("source", F.lit("src"), F.lit("LEAN_")), F.lit("\n"))
    return table(spark, d, "documents").groupBy("source", text.backend_name(named).alias("backend")).agg(F.count("*").alias("n"))


@query(
    "trace_keys",
    "SELECT conv_id, turn, sha256(role || chr(0) || text || chr(0)) AS ended, sha256(role || chr(0) || text) AS joined, substr(sha1(text), 1, 16) AS state_hash, text <> '' AND text <> role AS state_changed FROM conversations",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    role, said = F.col("role"), F.col("text")
    changed = (F.coalesce(F.length(said) > 0, F.lit(False)) & F.coalesce(said != role, F.lit(False))).alias("state_changed")
    return table(spark, d, "conversations").select("conv_id", "turn", hashing.nul_ended_key(role, said).alias("ended"), hashing.nul_joined_key(role, said).alias("joined"), hashing.state_hash(said).alias("state_hash"), changed)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@query(
    "char_ids",
    f"""WITH c AS (SELECT item_id, list_transform(list_filter(string_split(lower(text), ''), lambda x: x <> ''), lambda x: CASE WHEN strpos('{_ALPHABET}', x) > 0 THEN strpos('{_ALPHABET}', x) + 3 ELSE 3 END) AS ids FROM benchmark)
SELECT item_id, array_to_string(ids, ' ') AS ids, array_to_string(list_concat(list_concat([1], ids)[1:19], [2]), ' ') AS target FROM c""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = hashing.dense_id(list(_ALPHABET), F.lower("text"))
    target = hashing.target_ids(ids, 20)
    show = lambda a: F.array_join(a.cast("array<string>"), " ")
    return table(spark, d, "benchmark").select("item_id", show(ids).alias("ids"), show(target).alias("target"))


@query("json_lines", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","nothing":null,"user_id":' || user_id || '}' AS line FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.lit(None).cast("string").alias("nothing"))
    lines = jsonl.to_json(rows)
    return lines.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.col("value").alias("line"))


# -- arithmetic


@query(
    "standardise_round_trip",
    f"""WITH s AS (SELECT dim, avg(x) AS m, greatest(stddev_samp(x), 0.001) AS d FROM (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim),
e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest({_D}) AS x FROM embeddings)
SELECT vec_id, round(sum(abs((x - m) / d)), 4) AS z, round(sum((x - m) / d * d + m), 4) AS back FROM e JOIN s USING (dim) GROUP BY vec_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    stats = generate.latent_statistics(rows, "embedding").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))  # one row, a vector long
    both = rows.join(F.broadcast(stats)).select("vec_id", "embedding", F.col("s.mean").alias("m"), F.col("s.std").alias("d"))
    z = arithmetic.standardise(F.col("embedding"), F.col("m"), F.col("d"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4)
    return both.select("vec_id", total(F.transform(z, F.abs)).alias("z"), total(arithmetic.unstandardise(z, F.col("m"), F.col("d"))).alias("back"))


@query(
    "time_embeddings",
    """WITH t AS (SELECT event_id, value / 100 AS t FROM events), k AS (SELECT unnest(range(3)) AS k)
SELECT event_id, round(sum(sin(t * 1000 * exp(-ln(10000.0) * k / 3))), 4) + 0 AS sines, round(sum(cos(t * 1000 * exp(-ln(10000.0) * k / 3))), 4) + 0 AS cosines, CAST(0 AS DOUBLE) AS pad FROM t, k GROUP BY event_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", arithmetic.time_embedding(F.col("value") / 100, 7).alias("e"))
    total = lambda a, n: F.round(sum(F.get("e", F.lit(k)) for k in range(a, n)), 4) + F.lit(0.0)
    return rows.select("event_id", total(0, 3).alias("sines"), total(3, 6).alias("cosines"), F.get("e", F.lit(6)).alias("pad"))


@query("beam_scores", "SELECT event_id, round(-value / pow(greatest(event_id % 30 - 1, 1), 0.7), 6) AS score FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(arithmetic.beam_score(-F.col("value"), F.col("event_id") % 30, 0.7), 6).alias("score"))


@query("best_epochs", "SELECT l_linenumber AS run, arg_max(l_orderkey, (l_quantity, -l_extendedprice, -l_orderkey)) AS epoch FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("epoch"), F.col("l_quantity").alias("val_exact"), F.col("l_extendedprice").alias("val_loss"))
    return metrics.first_best(log, by=("l_linenumber",)).withColumnRenamed("l_linenumber", "run")


# -- lookups, rankers, generators


@query(
    "family_of_top1",
    """WITH f AS (SELECT event_type AS action, list_sort(list(DISTINCT family)) AS families FROM (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE 'act' END AS family FROM events UNION ALL SELECT 'purchase', 'look') GROUP BY 1)
SELECT e.event_id, CASE WHEN len(f.families) = 1 THEN f.families[1] ELSE '<ambiguous/other>' END AS predicted_family FROM events e LEFT JOIN f ON f.action = e.event_type""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("top1"))
    look = F.when(F.col("top1").isin("click", "view"), "look").otherwise("act")
    named = e.select("top1", look.alias("family")).distinct().union(spark.createDataFrame([("purchase", "look")], "top1 string, family string"))
    seeds = named.groupBy("family").agg(F.collect_set("top1").alias("expected_success_tactics"))
    actions = jsonl.families_of_actions(seeds.select(F.struct(F.col("family").alias("pattern_family"), "expected_success_tactics").alias("metadata")))
    return lookup.unique_family(e, actions, "top1").select("event_id", "predicted_family")


@query(
    "train_and_eval_rows",
    """WITH r AS (SELECT source, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split, doc_id % 5 <> 0 AS success FROM (SELECT source, doc_id, CAST(('0x' || substr(sha256(source || '|42'), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS u FROM documents))
SELECT 'train' AS part, count(*) AS n, count(DISTINCT source) AS n_groups FROM r WHERE success AND split = 'train' UNION ALL SELECT 'held', count(*), count(DISTINCT source) FROM r WHERE success AND split = 'val'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("source").alias("theorem_name"), F.lit("s").alias("theorem_statement"), F.col("lang").alias("state_before"), F.md5("text").alias("tactic"), hashing.hash_split(F.col("source")).alias("split"), (F.col("doc_id") % 5 != 0).alias("success")
    )
    train, held = dataset.train_and_eval(dataset.examples(docs), "val")
    told = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.countDistinct("theorem_name").alias("n_groups"))
    return told(train, "train").union(told(held, "held"))


@query(
    "tfidf_cosine",
    """WITH w AS (SELECT item_id, ' ' || w || ' ' AS w FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark)),
g AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, substr(w, i, k) AS g, length(w) AS len, i, k FROM (SELECT item_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS k))) GROUP BY ALL),
df AS (SELECT g, count(*) AS df FROM g GROUP BY g), t AS (SELECT count(DISTINCT item_id) AS n FROM g),
x AS (SELECT item_id, g.g, g.n * (ln((t.n + 1.0) / (df + 1.0)) + 1.0) AS v FROM g JOIN df USING (g), t), norm AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM x GROUP BY item_id),
s AS (SELECT a.item_id AS row_id, b.item_id, sum(a.v * b.v) / (any_value(na.norm) * any_value(nb.norm)) AS score FROM x a JOIN x b ON a.g = b.g JOIN norm na ON na.item_id = a.item_id JOIN norm nb ON nb.item_id = b.item_id WHERE a.item_id % 10 = 0 AND a.item_id <> b.item_id GROUP BY ALL)
SELECT row_id, item_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item_id) AS n FROM s) WHERE n <= 3""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    grams = rank.word_gram_rows(table(spark, d, "benchmark"), "item_id", F.col("text"))
    weighted = rank.tfidf(grams, grams, "item_id")
    asked = weighted.filter(F.col("item_id") % 10 == 0).withColumnRenamed("item_id", "row_id")
    near = rank.gram_cosine(asked, weighted, "row_id", "item_id").filter("row_id <> item_id")
    return lookup.ranked(near, "row_id", 3, F.desc("score"), F.col("item_id")).select("row_id", "item_id", F.round("score", 5).alias("score"))


@query("truncation", "SELECT count(*) FILTER (length(text) > 1000) AS truncated, count(*) AS n FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return generate.truncated(table(spark, d, "documents"), "text", 1000)


@query("snap_library", "SELECT CAST(row_number() OVER (ORDER BY text) - 1 AS INT) AS idx, text FROM (SELECT role AS text FROM conversations UNION SELECT event_type FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "conversations").select(F.col("role").alias("t"))
    return generate.library(roles.union(table(spark, d, "events").select("event_type")), "t")


@query(
    "offline_report",
    """WITH p AS (SELECT user_id, list(event_type ORDER BY event_id) AS p, arg_max(event_type, event_id) AS truth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 8 GROUP BY user_id)
SELECT count(*) AS n, avg((p[1] = truth)::INT) AS top1_exact, avg(list_contains(p[1:5], truth)::INT) AS top5_contains, avg(len(list_distinct(p))) AS avg_distinct, (SELECT count(DISTINCT x) FROM (SELECT unnest(p) AS x FROM p)) AS unique_predictions FROM p""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    first = lookup.ranked(table(spark, d, "events"), "user_id", 8, F.col("event_id"))
    rows = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda s: s["event_type"]).alias("predictions"), F.max_by("event_type", "event_id").alias("ground_truth_tactic"))  # 8 for each user
    return evaluate.offline(rows)


@query("mock_proposal_sizes", "SELECT conv_id, 6 AS n, 'sorry' AS last, true AS repeats_first, 5 AS n_distinct FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.col("conv_id").cast("string").alias("theorem_name"), F.lit("⊢ p").alias("state"))
    made = proposers.mock(states, 4)
    a = F.col("candidates")
    return made.select(F.col("theorem_name").cast("bigint").alias("conv_id"), F.size(a).alias("n"), F.element_at(a, -1).alias("last"), (F.element_at(a, -2) == F.element_at(a, 1)).alias("repeats_first"), F.size(F.array_distinct(a)).alias("n_distinct"))


# -- summaries and reports


@query(
    "summary_warnings",
    f"""WITH {EVENT_TRACES}, p AS (SELECT 'all' AS part, * FROM ev UNION ALL SELECT 'views', * FROM ev WHERE tactic = 'view' UNION ALL SELECT 'real', * REPLACE ('real' AS model, coalesce(backend, 'x') || '-real' AS backend) FROM ev UNION ALL SELECT 'none', * FROM ev WHERE false),
n AS (SELECT unnest(['all', 'views', 'real', 'none']) AS part),
a AS (SELECT n.part, count(tactic) AS total, count(*) FILTER (success) AS hits, count(*) FILTER (success) - count(DISTINCT CASE WHEN success THEN state_before || chr(0) || tactic END) AS dups,
  coalesce(bool_and(coalesce(model, 'None') = 'mock'), true) AS m, coalesce(bool_and(coalesce(backend, 'None') = 'mock'), true) AS b, coalesce(bool_and(CASE WHEN success THEN coalesce(state_after = '<verified by lean-cli>', false) END), false) AS ph FROM n LEFT JOIN p USING (part) GROUP BY n.part)
SELECT part, CASE WHEN total = 0 THEN true ELSE m END AS all_mock_model, total > 0 AND b AS all_mock_backend, total AS n, array_to_string(list_filter([CASE WHEN total = 0 THEN 'no records' END, CASE WHEN total > 0 AND (m OR b) THEN 'all records come from a mock; nothing was verified' END,
  CASE WHEN hits > 0 AND CAST(dups AS DOUBLE) / hits >= 0.3 THEN 'high duplicate rate' END, CASE WHEN ph THEN 'all successes were verified as whole files, without intermediate states' END], lambda x: x IS NOT NULL), '|') AS warnings FROM a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ev = event_traces(spark, d)
    real = ev.withColumn("model", F.lit("real")).withColumn("backend", F.concat(F.coalesce("backend", F.lit("x")), F.lit("-real")))
    out = None
    for part, rows in (("all", ev), ("views", ev.filter("tactic = 'view'")), ("real", real), ("none", ev.limit(0))):
        s = summary.summarise(rows)
        told = s.select(F.lit(part).alias("part"), "all_mock_model", ((F.col("total") > 0) & F.col("all_mock_backend")).alias("all_mock_backend"), F.col("total").alias("n"), F.array_join("warnings", "|").alias("warnings"))
        out = told if out is None else out.union(told)
    return out


@query(
    "runnable_seeds",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'no template' WHEN turn % 3 = 1 AND NOT contains(text, 'th') THEN 'no placeholder in the template' END AS problem FROM conversations",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 3
    seeds = table(spark, d, "conversations").select("conv_id", "turn", F.when(m == 1, F.col("text")).when(m == 2, F.concat("text", F.lit("__TACTIC__"))).alias("template"), F.when(m == 1, "th").alias("placeholder"))
    return verify.runnable(seeds).select("conv_id", "turn", "problem")


@query(
    "collect_counters",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, unnest(['simp', 'rfl', 'exact h', 'sorry', 'intro x', 'rfl', '- rfl']) AS t FROM s), n AS (SELECT (SELECT count(*) FROM s) AS n)
SELECT n * 4 AS attempted, n * 3 AS succeeded, n * 2 AS finished, CAST(0 AS BIGINT) AS timeouts, CAST(0.75 AS DOUBLE) AS success_rate, n * 2 AS duplicates, n AS forbidden FROM n""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("theorem_name")).distinct()
    seeds = names.select("theorem_name", F.lit("True").alias("theorem_statement"), F.lit("").alias("initial_state"))
    offered = F.array(*map(F.lit, ("simp", "rfl", "exact h", "sorry", "intro x", "rfl", "- rfl")))
    offers = names.select("theorem_name", F.lit("⊢ True").alias("state_before"), offered.alias("candidates"), F.lit("file").alias("source"), F.lit("x").alias("prompt_style"), F.lit(0).alias("_file_ord"), F.lit(0).alias("_line_no"))
    told = collect.report(collect.collect(seeds, offers)).join(F.broadcast(collect.drops(seeds, offers).select("duplicates", "forbidden")))  # one row each
    return told.select("attempted", "succeeded", "finished", "timeouts", "success_rate", "duplicates", "forbidden")
