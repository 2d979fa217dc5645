"""Shared-folder tables and small plan helpers for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+`` (ASCII only, by contract).
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where driver and tasks share folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/sievetrace-{spark.sparkContext.applicationId}"


#: Folders of tables that were written inside of recorded() and not released yet, with the step that wrote them.
_recorded: dict[str, int] = {}
_recording: int | None = None


@contextmanager
def recorded(step: int = 0) -> Iterator[None]:
    """Remember the tables that are written inside, for release()."""
    global _recording
    before, _recording = _recording, step
    try:
        yield
    finally:
        _recording = before


def _status(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(docs: DataFrame, step: int = 1) -> None:
    """Delete the tables that earlier steps than ``step`` recorded, if ``docs`` was written after them.

    For a step whose input is the written result of the step before.  Tables that ``docs`` reads stay, and so do
    those that are newer than its files: their step's result may not have been read yet.
    """
    spark = docs.sparkSession
    old = [p for p, s in _recorded.items() if s < step]
    read = docs.inputFiles() if old else []
    if not read:
        return
    where, fs = _status(spark, read[0])
    written = fs.getFileStatus(where).getModificationTime()
    for path in [p for p in old if not any(p.rpartition("/")[2] in f for f in read)]:
        where, fs = _status(spark, path)
        if not fs.exists(where) or fs.getFileStatus(where).getModificationTime() <= written:
            fs.delete(where, True)
            del _recorded[path]


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with as many ``_`` after it as make it differ from the names that are taken, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    Compressed and columnar, so later steps read only the columns they use.  One folder for each
    application; it may be removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _recording is not None:
        _recorded[path] = _recording
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that goes to a Python worker: whole texts may be long, and both sides hold a batch at a time.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches of at most ``BATCH_ROWS`` rows from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(df.sparkSession.conf.get(key))
    if most <= 0 or most > BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def text_bytes(df: DataFrame, col: str) -> int:
    """UTF-8 bytes of a text column over all rows (one pass, one number to the driver)."""
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0
