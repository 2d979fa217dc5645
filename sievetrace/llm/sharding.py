"""Contiguous shards of near equal bytes from global prefix sums, in DataFrame functions only.

Rows (id, size, checksum; texts stay where they are) are range-partitioned by id.  Each partition's total
goes into one prefix sum over the partitions, each partition adds its own running sum, and a row whose
middle byte lies in the k-th of equal parts of all bytes belongs to shard k: shards are contiguous in id
order, and differ from the mean by one row at most.  Slots come from row numbers in the same way.

Defined cases: null text has no bytes (size 8, checksum 0); null ids come first; equal rows stand next to
each other, in any order; an empty table gives an empty table; other columns are ignored.  Copies of a text
aren't kept together: one text may hold more bytes than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.llm.runtime import table

SHARDS = 24
#: Bytes of a row besides its text.
ROW_BYTES = 8


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    spark = docs.sparkSession
    order = ["doc", "text_crc32", "size"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = table(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    # one row for each partition: a bounded table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    totals = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    total = placed.agg(F.sum("size")).first()[0] or 1

    inside = Window.partitionBy("part").orderBy(*order)
    summed = placed.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(inside).alias("nth"))
    summed = summed.join(F.broadcast(totals), "part")
    middle = 2 * (F.col("bytes_before") + F.col("run")) - F.col("size")  # twice the middle byte
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * n / (2 * total)).cast("int"), F.lit(n - 1))
    dealt = table(summed.select("doc", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("at")))
    first = dealt.groupBy("shard").agg(F.min("at").alias("first"))  # one row for each shard
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("doc").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def oracle_sql() -> str:
    """DuckDB SQL for :func:`shards`; CRC-32 from its table, which a rule gives."""
    return r"""
WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(size - 7 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(bits.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM r, bits),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
s AS (SELECT doc_id, size, text_crc32, CAST(least(23, (2 * upto - size) * 24 // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
