"""Line-delimited JSON: comment-tolerant scans that keep the order of files and lines, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievetrace import schema
from sievetrace.functions.text import strip
from sievetrace.sources.working import numbered, written

ORDER = ("_file_ord", "_line_no")


def _paths(spark: SparkSession, path: str) -> list[str]:
    """Files that a path or glob names, sorted; through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of several paths or globs in the callers' order; FileNotFoundError for one that names none."""
    out = []
    for p in paths:
        found = _paths(spark, p)
        if not found:
            raise FileNotFoundError(p)
        out += found
    return out


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file_ord, _line_no, raw) of the lines that are neither blank nor comments.

    Files are read in splits.  A line's number is its place in its split and the lines of the file's earlier
    splits, which are counted first: one row for each split goes to all tasks.
    """
    if not paths:
        return spark.createDataFrame([], "_file_ord int, _line_no bigint, raw string")
    tail = lambda c: F.regexp_replace(c, r"^([a-z]+):/+", "$1:/")  # noqa: E731  # 'file:/x' and 'file:///x' are the same file
    order = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "_path string, _file_ord int").withColumn("_path", tail(F.col("_path")))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(paths).select("value", tail(place["file_path"]).alias("_path"), place["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = lines.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(order), "_path")
    numbered = lines.join(F.broadcast(pieces.drop("_n")), ["_path", "_start"])
    kept = numbered.select("_file_ord", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line_no"), strip(F.col("value")).alias("raw"))
    return kept.filter((F.length("raw") > 0) & ~F.col("raw").startswith("#"))


def records(spark: SparkSession, paths: list[str], ddl: str, missing_ok: bool = True) -> DataFrame:
    """Parsed records with their order and ``_corrupt`` (the raw line where it is no JSON object)."""
    found = [f for p in paths for f in _paths(spark, p)] if missing_ok else expand(spark, paths)
    parsed = raw_lines(spark, found).withColumn("row", F.from_json("raw", f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(*ORDER, "raw", "row.*")


def malformed(rows: DataFrame) -> DataFrame:
    """(_file_ord, _line_no, warning) of the lines that are no JSON objects."""
    return rows.filter("_corrupt is not null").select(*ORDER, F.format_string("line %d: not a JSON object, skipped", "_line_no").alias("warning"))


def keys(raw: str = "raw") -> F.Column:
    """Keys of a raw JSON object."""
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def with_validity(rows: DataFrame, required: tuple[str, ...], allowed: tuple[str, ...] | None = None, nullable: tuple[str, ...] = ("state_after",)) -> DataFrame:
    """``_valid``: an object with the required keys, none of them null but the nullable ones, and no key that isn't allowed."""
    ok = F.col("_corrupt").isNull()
    for key in required:
        ok = ok & F.array_contains(keys(), key)
        if key not in nullable:
            ok = ok & F.col(f"`{key}`").isNotNull()
    if allowed is not None:
        ok = ok & (F.size(F.array_except(keys(), F.array(*map(F.lit, allowed)))) == 0)
    return rows.withColumn("_valid", F.coalesce(ok, F.lit(False)))


def traces(spark: SparkSession, paths: list[str], missing_ok: bool = False) -> DataFrame:
    """Trace records of several files, with defaults and validity."""
    rows = with_validity(records(spark, paths, schema.TRACES, missing_ok), schema.TRACE_KEYS)
    defaults = {"timeout": F.lit(False), "source": F.lit("llm"), "model": F.lit("unknown"), "backend": F.lit("unknown"), "step_index": F.lit(0)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def seeds(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Valid seeds in the order of the file, the first ``most`` of them; ValueError if there are none."""
    rows = with_validity(records(spark, [path], schema.SEEDS), schema.SEED_REQUIRED, schema.SEED_KEYS).filter("_valid")
    rows = rows.withColumns({"placeholder": F.coalesce("placeholder", F.lit(schema.ACTION_SLOT)), "imports": F.coalesce("imports", F.array().cast("array<string>"))})
    rows = rows.orderBy(*ORDER).limit(most) if most is not None else rows
    if rows.isEmpty():
        raise ValueError(f"no seeds in {path}")
    return rows


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows of proposals; a missing file has none."""
    rows = with_validity(records(spark, [path], schema.CANDIDATES), schema.CANDIDATE_REQUIRED).filter("_valid")
    return rows.withColumns({"candidates": F.coalesce("candidates", F.array().cast("array<string>")), "source": F.coalesce("source", F.lit("manual-file"))})


def families(seeds: DataFrame) -> DataFrame:
    """(theorem_name, family): non-empty families; the last of several seeds of a name."""
    named = seeds.select("theorem_name", F.col("metadata.pattern_family").alias("family"), *ORDER).filter(F.length("family") > 0)
    return named.groupBy("theorem_name").agg(F.max_by("family", F.struct(*ORDER)).alias("family"))


def families_of_actions(seeds: DataFrame) -> DataFrame:
    """(tactic, families): the families whose seeds expect an action."""
    rows = seeds.select(F.col("metadata.pattern_family").alias("family"), F.explode("metadata.expected_success_tactics").alias("tactic"))
    return rows.filter(F.length("family") > 0).groupBy("tactic").agg(F.array_sort(F.collect_set("family")).alias("families"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(theorem_name, split) of a splits file; a later split overrides an earlier one (train, val, test)."""
    ddl = "train array<string>, val array<string>, test array<string>"
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("r"))
    parts = [row.select(F.explode(f"r.{s}").alias("theorem_name"), F.lit(s).alias("split"), F.lit(k).alias("k")) for k, s in enumerate(("train", "val", "test"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("theorem_name").agg(F.max_by("split", "k").alias("split"))


# -- sinks


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, keys sorted, nulls kept."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, mode: str = "overwrite", order: tuple[str, ...] = ()) -> int:
    """Write rows as JSON lines (a folder of part files) and tell how many; with ``order``, one sorted file."""
    kept = written(df)  # computed once, and counted by its files' footers
    rows = to_json(kept.drop(*order)) if not order else to_json(kept.orderBy(*order).coalesce(1).drop(*order))
    rows.write.mode(mode).text(path)
    return kept.count()


def append(df: DataFrame, path: str) -> int:
    """Add rows as JSON lines and tell how many."""
    return write(df, path, mode="append")


def write_routed(traces: DataFrame, path: str) -> None:
    """Successful and failed attempts in folders of their own, which later scans prune by."""
    traces.write.mode("append").partitionBy("success").parquet(path)


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of :func:`write_routed`; filters on ``success`` prune folders."""
    return spark.read.parquet(path).withColumn("success", F.col("success").cast("boolean"))


def distinct_text(df: DataFrame, col: str) -> DataFrame:
    """(ord, line): distinct values in order (sorted before newlines are escaped)."""
    rows = df.select(F.col(col).alias("raw")).filter("raw is not null").distinct()
    return rows.select("raw", F.replace("raw", F.lit("\n"), F.lit("\\n")).alias("line"))


def skeleton(seeds: DataFrame) -> DataFrame:
    """An empty row of proposals for each seed."""
    return seeds.select("theorem_name", F.col("initial_state").alias("state_before"), F.array().cast("array<string>").alias("candidates"))


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """Give rows of a table without files an order: ``_file_ord`` 0 and ``_line_no`` (from 1) by columns."""
    return numbered(df, "_line_no", *by).withColumn("_file_ord", F.lit(0)).withColumn("_line_no", F.col("_line_no") + 1)
