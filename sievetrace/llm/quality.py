"""Quality rules with host-level verdicts, in DataFrame functions only.

A document's own rules come first.  Their failures are then counted by host (the ``source`` column), and each
host's failure rates are shrunk towards all hosts' by a beta prior that is fitted to the hosts' rates (method
of moments; the prior counts as 2 documents at least and 1,000 at most, so a few hosts of equal rates don't
outweigh any number of a host's own documents).  A host rejects its documents if, for any rule, its posterior
rate less ``SURE`` standard deviations is above that rule's limit: half of the documents, or the prior's mean
and two of its standard deviations if that is more.  So a host of few documents, or one that is like the
others in a corpus that fails a rule often, rejects none.

Defined cases: null text has no words and fails; a null host is no host: it is neither counted nor
rejected; rows are never joined by their id, so repeated or null ids are judged as rows of their own; an
empty table gives an empty table; ties need no order.  Other columns pass through; the struct that
:func:`judge` adds steps aside for one of its name (``quality_``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import let
from sievetrace.llm.runtime import SPACES, free_name, table

LEAST_WORDS = 20
#: Words in repeated windows, in hundredths of all words, above which a document fails.
MOST_REPEATED = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Failure rate that a host must surely exceed to be rejected, and how many standard deviations make sure.
HOST_LIMIT, SURE = 0.5, 2.0
#: The prior counts as so many documents at least and at most.
PRIOR_WEIGHT = (2.0, 1000.0)
#: Names of a document's own rules.
RULES = ("short", "repeated", "symbols", "lines")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that stand twice or more in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.when(k > 0, F.get(p, k - 1)["h"] == x["h"]), F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(starts, none, lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")))["n"]

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
        return F.when(F.size(w) > window, some).otherwise(F.lit(0))

    return let(words, of).cast("long")


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (bigint)."""
    text = F.coalesce(text, F.lit(""))
    has_word = rf"[^ \t\n\x0B\f\r]"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own")))
    by_words = let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    return let(
        F.struct(counted.alias("lines"), by_words.alias("words")),
        lambda x: F.struct(
            x["words"]["n"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["lines"]["all"].alias("n_lines"),
            (x["lines"]["all"] - x["lines"]["own"]).alias("n_dup_lines"),
            x["words"]["repeated"].alias("n_repeat_words"),
        ),
    )


def _own_rules(m: Column) -> Column:
    return F.struct(
        (m["n_words"] < LEAST_WORDS).alias("short"),
        (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]).alias("repeated"),
        (10 * m["n_symbols"] > m["word_chars"]).alias("symbols"),
        (100 * m["n_dup_lines"] > MOST_REPEATED * m["n_lines"]).alias("lines"),
    )


def host_rates(judged: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT, sure: float = SURE) -> DataFrame:
    """A row for each host: docs, and by rule failures, rate, shrunk rate, lower bound and limit; and whether the host is rejected.

    ``judged`` has the struct ``fails``.  Counts are aggregated before the shuffle, and the moments of the hosts' rates
    are one row.
    """
    hosts = judged.filter(F.col(host_col).isNotNull()).groupBy(host_col)
    hosts = table(hosts.agg(F.count("*").alias("docs"), *(F.sum(F.col(f"fails.{r}").cast("long")).alias(r) for r in RULES)))
    rate = {r: F.col(r) / F.col("docs") for r in RULES}
    moments = hosts.agg(*(f(rate[r]).alias(f"{r}_{n}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_pop)))).first()
    columns = []
    for r in RULES:
        mean, var = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1 if var > 0 else PRIOR_WEIGHT[1], PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        shrunk = (F.col(r) + mean * weight) / (F.col("docs") + weight)
        spread = F.sqrt(shrunk * (1 - shrunk) / (F.col("docs") + weight + 1))
        least = max(limit, mean + 2 * (mean * (1 - mean) / (weight + 1)) ** 0.5)
        columns += [rate[r].alias(f"{r}_raw"), shrunk.alias(f"{r}_rate"), (shrunk - sure * spread).alias(f"{r}_bound"), F.lit(least).alias(f"{r}_limit")]
    rejected = reduce(or_, (F.col(f"{r}_bound") > F.col(f"{r}_limit") for r in RULES))
    return hosts.select("*", *columns).withColumn("rejected", rejected)


def _judged(docs: DataFrame, names: list[str], text_col: str, host_col: str, limit: float) -> DataFrame:
    """(row, quality): each row's own columns, and its verdict."""
    measured = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    judged = table(measured.withColumn("fails", _own_rules(F.col("m"))))
    rates = host_rates(judged.select("host", "fails"), "host", limit)
    own = rates.select("host", F.struct("docs", *(f"{r}_{k}" for r in RULES for k in ("raw", "rate", "bound")), "rejected").alias("of_host"))
    failed = F.col("fails.short") | F.col("fails.repeated")
    rejected = F.coalesce("of_host.rejected", F.lit(False))
    quality = F.struct("m", "fails", "of_host", failed.alias("base_failed"), rejected.alias("host_rejected"), (~failed & ~rejected).alias("kept"))
    return judged.join(own, "host", "left").select("row", quality.alias("quality"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """Columns ``keep`` (all by default) of each row and the struct ``quality``: m (the measures), fails, of_host (the
    host's documents and rates), base_failed, host_rejected, kept.  The rows are written once to the shared folder, so
    texts are measured once."""
    names = docs.columns if keep is None else keep
    rows = _judged(docs, names, text_col, host_col, limit)
    return rows.select("row.*", F.col("quality").alias(free_name("quality", names)))


def measured(docs: DataFrame) -> DataFrame:
    """The registered query's columns, the host's by rule rounded."""
    q = judge(docs, keep=["doc_id"])
    own = [F.col(f"quality.m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rates = [F.round(F.col(f"quality.of_host.{r}_{k}"), 6).alias(f"host_{r}_{k}") for r in RULES for k in ("raw", "rate", "bound")]
    return q.select("doc_id", *own, "quality.base_failed", "quality.kept", "quality.host_rejected", F.col("quality.of_host.docs").alias("host_docs"), *rates)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    return _judged(docs, docs.columns, text_col, host_col, limit).filter("quality.kept").select("row.*")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`measured`."""
    return r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
win AS (SELECT r, i, list_slice(words, i, i + 7) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, CAST(sum(least(8, i - prev)) AS BIGINT) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS prev FROM dup) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeated, 10 * n_symbols > word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM m),
h AS (SELECT source, count(*) AS docs, unnest([sum(short::INT), sum(repeated::INT), sum(symbols::INT), sum(lines::INT)]) AS n, unnest([1, 2, 3, 4]) AS rule FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT rule, avg(n::DOUBLE / docs) AS mean, var_pop(n::DOUBLE / docs) AS var FROM h GROUP BY rule),
k AS (SELECT rule, mean, CASE WHEN var > 0 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / var - 1)) ELSE 1000.0 END AS weight FROM p),
t AS (SELECT source, rule, docs, n::DOUBLE / docs AS raw, (n + mean * weight) / (docs + weight) AS rate, docs + weight + 1 AS seen, greatest(0.5, mean + 2 * sqrt(mean * (1 - mean) / (weight + 1))) AS lim FROM h JOIN k USING (rule)),
b AS (SELECT source, rule, docs, round(raw, 6) AS raw, round(rate, 6) AS rate, rate - 2 * sqrt(rate * (1 - rate) / seen) AS bound, lim FROM t),
bad AS (SELECT source, any_value(docs) AS docs, bool_or(bound > lim) AS rejected, list(raw ORDER BY rule) AS raw, list(rate ORDER BY rule) AS rate, list(round(bound, 6) ORDER BY rule) AS bound FROM b GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
  NOT (short OR repeated) AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected, docs AS host_docs,
  raw[1] AS host_short_raw, rate[1] AS host_short_rate, bound[1] AS host_short_bound, raw[2] AS host_repeated_raw, rate[2] AS host_repeated_rate, bound[2] AS host_repeated_bound,
  raw[3] AS host_symbols_raw, rate[3] AS host_symbols_rate, bound[3] AS host_symbols_bound, raw[4] AS host_lines_raw, rate[4] AS host_lines_rate, bound[4] AS host_lines_bound
FROM f LEFT JOIN bad USING (source)
"""
