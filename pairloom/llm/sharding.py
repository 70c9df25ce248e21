"""Contiguous shards of nearly equal byte size, by global prefix sums.

Rows are put in one global order by ranges.  Each range ("partition") sums its
own bytes; the totals, one row a range, are summed into offsets; offset plus
running sum gives each row the byte position where it begins in the whole
corpus.  Equal targets cut that line, so every shard is a contiguous run.

Only DataFrame functions are used.  The text is read once: the first staged
table holds key, size and checksum alone, and ranges are drawn from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.shared import cut, table


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, shard and slot of every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1 (1 for null), so empty texts still
    spread.  A row whose middle byte lies between targets i and i+1 is in shard
    i: each cut is at the row border nearest to its target, and no shard is
    further from the mean than the longest row.  Order: key (nulls first), then
    checksum and size; rows equal in all three are alike, whichever comes first.
    A null text has a null checksum.  An empty table gives no rows.  Other
    columns of ``docs`` are not read.  A hot key is split over ranges by the
    checksum.
    """
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards)
    order = ["_key", "text_crc32", "size"]
    thin = cut(
        docs.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(
        thin.repartitionByRange(ranges, *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumns({"_end": F.sum("size").over(within), "_row": F.row_number().over(within).cast("long")})
    )
    totals = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(  # one row a range, so at most shuffle.partitions rows
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    # Twice the middle of the row, times shards, over twice the total; in whole numbers.
    shard = F.expr(f"((_byte0 + _end) * 2 - size) * {n_shards} div (_total * 2)")
    rows = placed.join(F.broadcast(offsets), "_range").select(
        "_key",
        "size",
        "text_crc32",
        shard.cast("int").alias("shard"),
        (F.col("_row0") + F.col("_row") - 1).alias("_index"),
    )
    starts = rows.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return rows.join(F.broadcast(starts), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, by bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum table and the bytes are worked out in SQL, as DuckDB has no CRC-32.
OP1_SQL = """
WITH RECURSIVE t(r, i, c) AS (
    SELECT 0, i, i::BIGINT FROM range(256) x(i)
    UNION ALL
    SELECT r + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE r < 8
), crc(v) AS (SELECT list(c ORDER BY i) FROM t WHERE r = 8),
b AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
           list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
    FROM documents
), s AS (
    SELECT doc_id, size::BIGINT AS size,
           xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM b, crc
), p AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e,
           row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) AS n, sum(size) OVER ()::BIGINT AS total
    FROM s
), q AS (SELECT *, ((e * 2 - size) * 16 // (total * 2))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM q
"""
