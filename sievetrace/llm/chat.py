"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation (each role but ``system``) the whole dialogue is rendered with that
speaker as assistant and all others as named users; only the speaker's own words and end marks are trained on.

:func:`rotate` has a row for each perspective and turn.  ``position`` numbers a conversation's turns from 0, the
same for every perspective: by turn, speaker and a digest of the row.  Numbers come from a range partitioning and
prefix sums, so a conversation with a third of all turns stays spread over tasks.  :func:`dialogues` joins the
segments to texts: a dialogue is one row, and one above ``part_chars`` characters several parts, cut between
turns at the same places for every perspective; no task gathers more than a part.

In texts and names ``<|`` becomes ``<\\|`` (and ``<\\`` becomes ``<\\\\``, so it can be undone), and in names
line breaks are written ``\\n`` and ``\\r`` and backslashes doubled: nobody can write a mark or another turn.

Defined cases: a null role is the participant ``unknown``; a null text is empty; a conversation of system
turns alone has no perspective and no rows; null conv_ids belong to no conversation and give no rows; null
turns come first, turns with equal numbers are ordered by speaker and digest, and repeated rows are repeated;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.llm.runtime import table

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of a part of a dialogue, counted with every speaker as a named user.
PART_CHARS = 1_000_000


def escape(text: Column) -> Column:
    """A text without marks."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_name(name: Column) -> Column:
    """A name on one line, without marks."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|")):
        name = F.replace(name, F.lit(raw), F.lit(shown))
    return name


def _head(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))


def _positions(thin: DataFrame, part_chars: int) -> DataFrame:
    """``thin`` (conv_id, turn, speaker, row_key, n) with ``position`` and ``part`` in its conversation."""
    order = ["conv_id", "turn", "speaker", "row_key", "copy"]
    pieces = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = thin.withColumn("copy", F.monotonically_increasing_id())  # tells equal rows apart, so that they can be cut between
    rows = table(rows.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()))

    # one row for each partition: a bounded table
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("piece").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
    totals = totals.select("piece", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "chars")))

    inside = Window.partitionBy("piece").orderBy(*order)
    run = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    numbered = rows.select("*", F.row_number().over(inside).alias("nth"), run.alias("run")).join(F.broadcast(totals), "piece")
    numbered = numbered.select("conv_id", "turn", "speaker", "row_key", (F.col("rows_before") + F.col("nth") - 1).alias("at"), (F.col("chars_before") + F.col("run")).alias("chars"))
    first = numbered.groupBy("conv_id").agg(F.min("at").alias("first_at"), F.min("chars").alias("first_chars"))
    part = F.floor((F.col("chars") - F.col("first_chars")) / part_chars).cast("int")
    return numbered.join(first, "conv_id").select("conv_id", "turn", "speaker", "row_key", (F.col("at") - F.col("first_at")).alias("position"), part.alias("part"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, perspective, position, part, turn, speaker, rendered_role, segment, mask, train_start and train_end
    (characters of the segment that are trained on; both 0 where mask is 0)."""
    said = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("said")
    )
    parts = (F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.col("speaker"), F.col("said"))
    said = said.withColumn("row_key", F.md5(F.concat_ws("\0", *parts)))
    as_user = F.concat(_head(F.lit("user"), escape_name(F.col("speaker"))), "said", F.lit(f"{CLOSE}\n"))
    placed = _positions(said.select("conv_id", "turn", "speaker", "row_key", F.length(as_user).cast("long").alias("n")), part_chars)

    people = said.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    texts = said.groupBy("row_key").agg(F.first("said").alias("said"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = _head(role, escape_name(F.col("speaker")))
    segment = F.concat(head, "said", F.lit(f"{CLOSE}\n"))
    return placed.join(people, "conv_id").join(texts.hint("merge"), "row_key").select(
        "conv_id", "perspective", "position", "part", "turn", "speaker", role.alias("rendered_role"), segment.alias("segment"), own.cast("int").alias("mask"),
        F.when(own, F.length(head)).otherwise(0).alias("train_start"), F.when(own, F.length(segment) - 1).otherwise(0).alias("train_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_segments, dialogue and train_spans (array of start and stop characters) of :func:`rotate`'s rows."""
    key = ["conv_id", "perspective", "part"]
    before = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    span = F.when(F.col("mask") == 1, F.struct((start + F.col("train_start")).alias("start"), (start + F.col("train_end")).alias("stop")))
    placed = rotated.select(*key, "position", "segment", span.alias("span"))
    joined = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "segment", "span"))).alias("all"))
    return joined.select(*key, F.size("all").alias("n_segments"), F.array_join("all.segment", "").alias("dialogue"), F.filter("all.span", lambda s: s.isNotNull()).alias("train_spans"))


def rendered(turns: DataFrame) -> DataFrame:
    """The registered query: every dialogue, its spans as text."""
    spans = F.array_join(F.transform("train_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return dialogues(rotate(turns)).select("conv_id", "perspective", "part", "n_segments", "dialogue", spans.alias("train_spans"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`rendered`."""
    return r"""
WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') AS said FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') AS name,
  md5(CAST(conv_id AS VARCHAR) || chr(0) || coalesce(CAST(turn AS VARCHAR), '') || chr(0) || speaker || chr(0) || said) AS row_key FROM s),
n AS (SELECT *, row_number() OVER w AS position, sum(length('<|im_start|>user name=' || name || chr(10) || said || '<|im_end|>' || chr(10))) OVER (w ROWS UNBOUNDED PRECEDING)
  - length('<|im_start|>user name=' || name || chr(10) || said || '<|im_end|>' || chr(10)) AS chars FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, row_key)),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (SELECT n.*, CAST(chars // 1000000 AS INT) AS part, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || name END AS called FROM n JOIN p USING (conv_id)),
g AS (SELECT *, '<|im_start|>' || called || chr(10) AS head, '<|im_start|>' || called || chr(10) || said || '<|im_end|>' || chr(10) AS segment FROM r),
o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY position ROWS UNBOUNDED PRECEDING) - length(segment) AS start FROM g)
SELECT conv_id, perspective, part, CAST(count(*) AS INT) AS n_segments, string_agg(segment, '' ORDER BY position) AS dialogue,
  coalesce(string_agg(CASE WHEN speaker = perspective THEN CAST(start + length(head) AS VARCHAR) || '-' || CAST(start + length(segment) - 1 AS VARCHAR) END, ',' ORDER BY position), '') AS train_spans
FROM o GROUP BY conv_id, perspective, part
"""
