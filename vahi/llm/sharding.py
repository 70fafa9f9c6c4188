"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vahi.llm.common import clean_text, stored, tasks


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put every row into one of `shards` contiguous runs of the order by id.

    A row weighs the UTF-8 bytes of its text plus 8. The rows are dealt to range partitions by id; one small row of
    totals a partition gives each partition its global offset in bytes and rows, and a running sum inside the partition does the rest,
    so no task sees more than a partition of (id, size, crc) rows. A row belongs to the shard in whose equal share of the
    total its middle byte lies: a shard misses its target by less than one row's size.

    Returns id, size, text_crc32, law, shard, slot, grown_shard. Null text: size 8 and the crc of nothing. Null ids come first;
    repeated ids are ordered by size and crc. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(clean_text(text_column)) + 8).cast("long").alias("size"),
        F.crc32(clean_text(text_column).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    dealt = stored(sized.repartitionByRange(tasks(spark), *order).withColumn("part", F.spark_partition_id()), "sharding")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")  # as many rows as partitions
        .select(
            *order,
            (F.col("rows_before") + F.col("nth")).alias("position"),
            F.expr(f"int(((2 * (bytes_before + upto) - size) * {int(shards)}) div (2 * all_bytes))").alias("shard"),
        )
    )
    placed = stored(placed, "sharding")
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # as many rows as shards
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
