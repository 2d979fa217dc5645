"""Text cleaning and rendering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.functions import text
from sievetrace.functions.arithmetic import let
from sievetrace.plans.registry import query
from sievetrace.plans.tables import table





#: List marks, comments and quotes around the lines of documents, so that cleaning has work.
_MARKED = "CASE {i} % 5 WHEN 0 THEN '1. ' || {x} WHEN 1 THEN '- ' || {x} || ' -- why' WHEN 2 THEN '\"' || {x} || '\"' WHEN 3 THEN '  ' || {x} ELSE {x} END"


def _marked(x: F.Column, i: F.Column) -> F.Column:
    m = i % 5
    return F.when(m == 0, F.concat(F.lit("1. "), x)).when(m == 1, F.concat(F.lit("- "), x, F.lit(" -- why"))).when(m == 2, F.concat(F.lit('"'), x, F.lit('"'))).when(m == 3, F.concat(F.lit("  "), x)).otherwise(x)


_LINES_SQL = f"""l AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS x FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
m AS (SELECT doc_id, i, {_MARKED.format(i="i", x="x")} AS x FROM l),
c1 AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '\\s*--.*$', ''), '^\\s*\\d+[.)]\\s+', '') AS x FROM m),
c2 AS (SELECT doc_id, i, trim(regexp_replace(x, '^\\s*[-*+]\\s+', ''), ' ' || chr(9) || chr(13)) AS x FROM c1),
c3 AS (SELECT doc_id, i, CASE WHEN length(x) >= 2 AND starts_with(x, '`') AND ends_with(x, '`') THEN trim(substr(x, 2, length(x) - 2)) ELSE x END AS x FROM c2),
c4 AS (SELECT doc_id, i, CASE WHEN length(x) >= 2 AND starts_with(x, '"') AND ends_with(x, '"') THEN trim(substr(x, 2, length(x) - 2)) ELSE x END AS x FROM c3),
c5 AS (SELECT doc_id, i, CASE WHEN length(x) >= 2 AND starts_with(x, '''') AND ends_with(x, '''') THEN trim(substr(x, 2, length(x) - 2)) ELSE x END AS x FROM c4),
c AS (SELECT doc_id, i, trim(trim(x, '`')) AS x FROM c5)"""


@query("clean_lines", f"WITH {_LINES_SQL} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(x)) AS BIGINT) AS n_chars, sha256(string_agg(x, chr(10) ORDER BY i)) AS digest FROM c WHERE x <> '' GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), _marked)
    kept = F.filter(F.transform(marked, text.clean_candidate), lambda x: x != "")
    told = let(kept, lambda k: F.struct(F.size(k).cast("long").alias("n_lines"), F.length(F.array_join(k, "")).cast("long").alias("n_chars"), F.sha2(F.array_join(k, "\n"), 256).alias("digest")))
    return table(spark, d, "documents").select("doc_id", F.inline(F.filter(F.array(told), lambda t: t["n_lines"] > 0)))


@query(
    "clean_dedup_lines",
    f"WITH {_LINES_SQL}, g AS (SELECT doc_id, x, count(*) AS n, regexp_matches(lower(x), '\\b(sorry|admit|unsafe)\\b') AS bad FROM c WHERE x <> '' GROUP BY doc_id, x) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_clean, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (bad) AS n_forbidden, count(*) FILTER (NOT bad) AS n_kept FROM g GROUP BY doc_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), _marked)
    some = F.filter(F.array(text.clean_candidates(marked)), lambda c: c["clean"] > 0)
    rows = table(spark, d, "documents").select("doc_id", F.inline(some))  # a filter after it would clean twice
    as_long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select("doc_id", as_long("clean", "n_clean"), as_long("duplicates", "n_duplicates"), as_long("forbidden", "n_forbidden"), F.size("kept").cast("long").alias("n_kept"))


@query("clean_forbidden", "SELECT lang, count(*) FILTER (regexp_matches(lower(text), '\\b(sorry|admit|unsafe)\\b')) AS n_forbidden, count(*) AS n FROM documents GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count_if(text.contains_forbidden(F.col("text"))).alias("n_forbidden"), F.count("*").alias("n"))


@query(
    "goal_count_blocks",
    "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(list_filter(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> ''))) END::INT AS n_goals FROM documents",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.replace("text", F.lit(". "), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", text.count_goals(blocks).cast("int").alias("n_goals"))


@query("goal_line", "SELECT doc_id, trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'T'))[1], text), ' ' || chr(9) || chr(10) || chr(13)) AS line FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.goal_line(F.col("text"), "T").alias("line"))


@query("template_render", "SELECT conv_id, turn, 'import A' || chr(10) || chr(10) || 'say __SLOT__'[1:4] || text || ' and ' || text || chr(10) AS source FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    source = text.render_template(F.lit("say __SLOT__ and __SLOT__"), F.lit("__SLOT__"), F.col("text"), F.array(F.lit("import A"), F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", source.alias("source"))


@query(
    "prompt_build",
    f"SELECT conv_id, turn, sha256('Theorem: ' || role || chr(10) || 'Statement:' || chr(10) || conv_id || chr(10) || chr(10) || 'Current proof state:' || chr(10) || text || chr(10) || chr(10) || '{text.STYLES['diverse'].format(k=8)}') AS digest FROM conversations",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = text.prompt(F.col("role"), F.col("conv_id").cast("string"), F.col("text"), 8, "no such style")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(asked, 256).alias("digest"))


@query("action_heads", "SELECT doc_id, regexp_replace(regexp_extract(text, '^\\s*\\(*\\s*(\\S+)', 1), '[,;]+$', '') AS head FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.head(F.col("text")).alias("head"))


@query("diagnostics_capped", "SELECT doc_id, CASE WHEN length(t) > 1500 THEN substr(t, 1, 1500) || '...[truncated]' ELSE t END AS said FROM (SELECT doc_id, trim(lang || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.diagnostics(F.col("lang"), F.col("text")).alias("said"))
