"""Ranker, metric and generation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions import arithmetic, hashing
from sievetrace.operators import generate, lookup, metrics, rank
from sievetrace.plans.registry import query
from sievetrace.plans.tables import table

#: Stated queries: vectors and documents whose id is divisible by 100, against all rows (vectors but themselves).
_EVERY = 100
_D = "CAST(embedding AS DOUBLE[])"
_KNN = f"""q AS (SELECT vec_id AS row_id, label AS truth, {_D} AS q FROM embeddings WHERE vec_id % {_EVERY} = 0),
t AS (SELECT vec_id, label, {_D} AS v FROM embeddings),
r AS (SELECT row_id, truth, vec_id, label, list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v))) AS score FROM q, t WHERE row_id <> vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM r),
p AS (SELECT row_id, any_value(truth) AS truth, list(CAST(label AS VARCHAR) ORDER BY rank) AS preds FROM n WHERE rank <= 20 GROUP BY row_id)"""


def _neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % _EVERY == 0).withColumnRenamed("vec_id", "row_id")
    return rank.nearest(asked, e, "embedding", "embedding", "row_id", "vec_id", "label", k, arithmetic.cosine, bigger=True, others=True)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Ranked label lists of the stated queries, the true label being what is verified."""
    near = _neighbours(spark, d, 20).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"].cast("string")).alias("predictions"))
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("ground_truth_tactic"))
    rows = near.join(truth, "row_id").withColumn("verified", F.array("ground_truth_tactic")).withColumn("theorem_name", F.concat(F.lit("v"), "row_id"))
    return metrics.flags(rows, accepted="verified")


@query("knn_label_top5", f"WITH {_KNN} SELECT row_id, vec_id, label, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM n WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 5).select("row_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query(
    "nn_snap_argmin",
    f"WITH q AS (SELECT vec_id AS row_id, {_D} AS q FROM embeddings WHERE vec_id % {_EVERY} = 0), t AS (SELECT vec_id, {_D} AS v FROM embeddings) SELECT row_id, vec_id FROM (SELECT row_id, vec_id, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(q, v), vec_id) AS n FROM q, t WHERE row_id <> vec_id) WHERE n = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % _EVERY == 0).withColumnRenamed("vec_id", "row_id")
    return rank.nearest(asked, e, "embedding", "embedding", "row_id", "vec_id", "label", others=True).select("row_id", "vec_id")


@query(
    "pass_at_k",
    f"""WITH {_KNN}, d AS (SELECT row_id, truth, label, min(rank) AS rank FROM n WHERE rank <= 20 GROUP BY ALL), o AS (SELECT row_id, truth, label, row_number() OVER (PARTITION BY row_id ORDER BY rank) AS rank FROM d),
f AS (SELECT row_id, bool_or(label = truth AND rank <= 1) AS p1, bool_or(label = truth AND rank <= 3) AS p3, bool_or(label = truth AND rank <= 5) AS p5 FROM o GROUP BY row_id)
SELECT count(*) AS n, avg(p1::INT) AS pass_at_1, avg(p3::INT) AS pass_at_3, avg(p5::INT) AS pass_at_5 FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metrics(_flags(spark, d)).select("n", "pass_at_1", "pass_at_3", "pass_at_5")


@query(
    "any_verified_at_k",
    f"""WITH {_KNN}, f AS (SELECT row_id, bool_or(label = truth AND rank <= 1) AS p1, bool_or(label = truth AND rank <= 3) AS p3, bool_or(label = truth AND rank <= 5) AS p5 FROM n GROUP BY row_id)
SELECT count(*) AS n, avg(p1::INT) AS top1_exact_rate, avg(p1::INT) AS any_verified_at_1, avg(p3::INT) AS any_verified_at_3, avg(p5::INT) AS any_verified_at_5, CAST(1 AS DOUBLE) AS oracle_coverage, count(*) <= 5 AS small_sample FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metrics(_flags(spark, d)).select("n", "top1_exact_rate", "any_verified_at_1", "any_verified_at_3", "any_verified_at_5", "oracle_coverage", "small_sample")


@query(
    "family_pass_at_k",
    f"""WITH {_KNN}, d AS (SELECT row_id, truth, label, min(rank) AS rank FROM n WHERE rank <= 20 GROUP BY ALL), o AS (SELECT row_id, truth, label, row_number() OVER (PARTITION BY row_id ORDER BY rank) AS rank FROM d),
f AS (SELECT row_id, any_value(truth) AS truth, bool_or(label = truth AND rank <= 1) AS p1, bool_or(label = truth AND rank <= 5) AS p5 FROM o GROUP BY row_id)
SELECT CAST(truth AS VARCHAR) AS family, count(*) AS n_rows, count(*) AS n_theorems, avg(p1::INT) AS pass_at_1, avg(p5::INT) AS pass_at_5, count(*) FILTER (p5) AS passed_5 FROM f GROUP BY truth""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    flagged = _flags(spark, d)
    families = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("theorem_name"), F.col("label").cast("string").alias("family"))
    return metrics.by_family(flagged, families).select("family", "n_rows", "n_theorems", "pass_at_1", "pass_at_5", "passed_5")


@query(
    "confusion_matrix",
    f"WITH {_KNN} SELECT CASE WHEN truth < 5 THEN 'low' ELSE 'high' END AS \"group\", CAST(truth AS VARCHAR) AS true_family, CAST(label AS VARCHAR) AS predicted_family, count(*) AS n FROM n WHERE rank = 1 GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    groups = {"low": tuple(map(str, range(5))), "high": tuple(map(str, range(5, 10)))}
    pairs = _flags(spark, d).select(F.col("ground_truth_tactic").alias("true_family"), F.get("predictions", F.lit(0)).alias("predicted_family"))
    return metrics.confusion(pairs, groups)


@query(
    "generation_stats",
    """WITH t AS (SELECT DISTINCT event_type AS tactic FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view'),
r AS (SELECT user_id, list(event_type ORDER BY event_id) AS p FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id), e AS (SELECT user_id, unnest(p) AS x FROM r),
f AS (SELECT user_id, x, x NOT IN (SELECT tactic FROM t) AS new, x IN ('click', 'view') AS ok FROM e)
SELECT (SELECT avg(length(p[1])) FROM r) AS avg_top1_chars, (SELECT avg(len(list_distinct(p))) FROM r) AS avg_distinct, CAST(0 AS DOUBLE) AS empty_rate,
  CAST(count(*) FILTER (new) AS DOUBLE) / count(*) AS novel_rate, CAST(count(*) FILTER (NOT ok) AS DOUBLE) / count(*) AS invalid_rate, count(*) FILTER (new AND ok) AS novel_verified,
  count(DISTINCT CASE WHEN new AND ok THEN user_id END) AS rows_by_novel FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    each = e.filter("ts >= timestamp '2024-01-15'").select("user_id", "event_id", F.col("event_type").alias("tactic"), F.col("event_type").isin("click", "view").alias("ok"))
    train = e.filter("ts < timestamp '2024-01-15' and event_type <> 'view'").select(F.col("event_type").alias("tactic"))
    rows = each.agg(F.countDistinct("user_id").alias("_rows"))
    return metrics.generation_of(each, rows, train, "user_id", "event_id", "ok")


@query("majority_topk", "SELECT event_type AS tactic, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rank.majority(table(spark, d, "events").select(F.col("event_type").alias("tactic")), 3)


@query(
    "char3_cosine",
    f"""WITH dq AS (SELECT doc_id AS k, '  ' || lower(text) || '  ' AS t FROM documents WHERE doc_id % {_EVERY} = 0), bq AS (SELECT item_id AS k, '  ' || lower(text) || '  ' AS t FROM benchmark),
dg AS (SELECT k, g, count(*) AS n FROM (SELECT k, substr(t, i, 3) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM dq)) GROUP BY ALL),
bg AS (SELECT k, g, count(*) AS n FROM (SELECT k, substr(t, i, 3) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM bq)) GROUP BY ALL),
dn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM dg GROUP BY k), bn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM bg GROUP BY k),
s AS (SELECT dg.k AS row_id, bg.k AS item_id, sum(dg.n * bg.n) / (any_value(dn.norm) * any_value(bn.norm)) AS score FROM dg JOIN bg USING (g) JOIN dn ON dn.k = dg.k JOIN bn ON bn.k = bg.k GROUP BY ALL)
SELECT row_id, item_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 3""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").filter(F.col("doc_id") % _EVERY == 0).withColumnRenamed("doc_id", "row_id")
    near = rank.gram_cosine(rank.gram_rows(asked, "row_id", F.col("text")), rank.gram_rows(table(spark, d, "benchmark"), "item_id", F.col("text")), "row_id", "item_id")
    return lookup.ranked(near, "row_id", 3, F.desc("score"), F.col("item_id")).withColumn("score", F.round("score", 6))


@query(
    "retrieval_predict",
    f"""WITH dq AS (SELECT doc_id AS k, '  ' || lower(lang || chr(10) || text) || '  ' AS t FROM documents WHERE doc_id % {_EVERY} = 0), bq AS (SELECT item_id AS k, '  ' || lower('b' || chr(10) || text) || '  ' AS t FROM benchmark),
dg AS (SELECT k, g, count(*) AS n FROM (SELECT k, substr(t, i, 3) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM dq)) GROUP BY ALL),
bg AS (SELECT k, g, count(*) AS n FROM (SELECT k, substr(t, i, 3) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM bq)) GROUP BY ALL),
dn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM dg GROUP BY k), bn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM bg GROUP BY k),
s AS (SELECT dg.k AS row_id, bg.k AS item_id, sum(dg.n * bg.n) / (any_value(dn.norm) * any_value(bn.norm)) AS score FROM dg JOIN bg USING (g) JOIN dn ON dn.k = dg.k JOIN bn ON bn.k = bg.k GROUP BY ALL),
a AS (SELECT dq.k AS row_id, bq.k AS item_id, coalesce(score, 0) AS score FROM dq CROSS JOIN bq LEFT JOIN s ON s.row_id = dq.k AND s.item_id = bq.k),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item_id) AS rank FROM a),
u AS (SELECT row_id, 't' || (item_id % 7) AS tactic, min(rank) AS best FROM r WHERE rank <= 16 GROUP BY ALL)
SELECT row_id, string_agg(tactic, ',' ORDER BY best) AS predictions FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY best) AS place FROM u) WHERE place <= 5 GROUP BY row_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    name = lambda key: F.col(key).cast("string").alias("theorem_name")
    train = table(spark, d, "benchmark").select(F.col("item_id").alias("train_id"), name("item_id"), F.lit("b").alias("theorem_statement"), F.col("text").alias("state_before"), F.concat(F.lit("t"), F.col("item_id") % 7).alias("tactic"))
    asked = table(spark, d, "documents").filter(F.col("doc_id") % _EVERY == 0).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("theorem_statement"), F.col("text").alias("state_before"))
    return rank.Retrieval().fit(train).transform(asked, 5).select("row_id", F.array_join("predictions", ",").alias("predictions"))


@query("latent_stats", "SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 0.001), 6) AS std FROM (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim")
def _(spark: SparkSession, d: str) -> DataFrame:
    return generate.latent_statistics(table(spark, d, "embeddings"), "embedding").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("flow_math", f"SELECT vec_id, round(list_sum({_D}), 5) AS reached, round(0.5 * list_sum({_D}), 5) AS halfway FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    field = arithmetic.velocity(zero, F.col("embedding"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    end = arithmetic.euler(zero, lambda z, t: field, 4)
    return table(spark, d, "embeddings").select("vec_id", total(end).alias("reached"), total(arithmetic.interpolate(zero, F.col("embedding"), 0.5)).alias("halfway"))


@query("softmax_argmax", f"WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings) SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS top FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", arithmetic.argmax(F.col("embedding")).alias("best"), F.round(F.array_max(arithmetic.softmax(F.col("embedding"))), 6).alias("top"))


@query("sample_frequency", "SELECT user_id, sample, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, sample) AS INT) AS rank FROM (SELECT user_id, event_type AS sample, count(*) AS n FROM events GROUP BY ALL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return generate.by_frequency(table(spark, d, "events").withColumnRenamed("event_type", "sample"), "user_id", "sample")


@query("vocab_build", "SELECT char, CAST(row_number() OVER (ORDER BY char) + 3 AS INT) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return generate.vocabulary(table(spark, d, "benchmark"), "text")


@query(
    "ngram_hash_features",
    """WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
m AS (SELECT item_id, 'F' AS tag, '^' || text || '$' AS m FROM benchmark UNION ALL SELECT item_id, 'G', '^' || split_part(text, '.', 1) || '$' FROM benchmark),
g AS (SELECT item_id, tag, substr(m, i, k) AS g FROM (SELECT item_id, tag, m, k, unnest(range(1, length(m) - k + 2)) AS i FROM m, (SELECT unnest([2, 3, 4]) AS k))),
x AS (SELECT tag, g, hex(encode(tag || chr(31) || g)) AS x FROM (SELECT DISTINCT tag, g FROM g)),
b AS (SELECT tag, g, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(x) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(bits.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 8192 AS INT) AS bucket FROM x, bits),
v AS (SELECT item_id, bucket, 1.0::DOUBLE AS v FROM (SELECT DISTINCT item_id, bucket FROM g JOIN b USING (tag, g) WHERE tag = 'F') UNION ALL SELECT item_id, bucket, 1.5::DOUBLE FROM g JOIN b USING (tag, g) WHERE tag = 'G'),
s AS (SELECT item_id, bucket, sum(v) AS v FROM v GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY item_id)
SELECT item_id, bucket, round(v / norm, 6) AS value FROM s JOIN n USING (item_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.explode(hashing.feature_rows(F.col("text"), F.substring_index("text", ".", 1))).alias("f"))
    summed = items.groupBy("item_id", "f.bucket").agg(F.sum("f.value").alias("value"))
    norms = summed.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, "item_id").select("item_id", "bucket", F.round(F.col("value") / F.col("norm"), 6).alias("value"))


@query("ngram_gram_counts", "SELECT item_id, g AS gram, count(*) AS n FROM (SELECT item_id, substr('^' || text || '$', i, 3) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(hashing.bounded_ngrams(F.col("text"), (3,))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("loglinear_fit")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "benchmark").select(
        F.col("item_id").alias("train_id"), F.lit("b").alias("theorem_statement"), F.col("text").alias("state_before"),
        F.when(F.length("text") > 180, "long").otherwise("short").alias("tactic"), hashing.hash_split(F.col("item_id").cast("string"), train=0.6, val=0.2, test=0.2).alias("split"),
    )
    asked = docs.filter("split <> 'train'").select(F.col("train_id").alias("row_id"), "theorem_statement", "state_before", F.col("tactic").alias("truth"), "split")
    found = rank.LogLinear().fit(docs.filter("split = 'train'")).transform(asked, 2)
    return found.groupBy("split", "truth").agg(F.count("*").alias("n"), F.count_if(F.get("predictions", F.lit(0)) == F.col("truth")).alias("right"))
