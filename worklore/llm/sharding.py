"""Contiguous shards of nearly equal bytes, from global prefix sums.

Built-in column functions only.  Rows are range-sorted by key over the cluster;
each partition sums its own rows, the partitions' totals give every partition its
base, and a row goes to the shard in whose equal share of all bytes its first
byte falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from worklore import session


def byte_shards(df: DataFrame, shards: int, *order: str, size: str = "size") -> DataFrame:
    """Adds shard (from 0) and slot (gapless from 0 within it), in the given order.

    A shard's bytes differ from an equal share by less than the largest row.
    Rows equal in order and size are interchangeable; null keys come first.  Text
    should be left out of df: all its columns are sorted.  Columns named shard
    and slot are replaced.
    """
    df = df.drop("shard", "slot", "part")
    sorted_rows = df.repartitionByRange(*order, size).sortWithinPartitions(*order, size)
    rows = session.stage(sorted_rows.withColumn("part", F.spark_partition_id()), "sharded")
    here = Window.partitionBy("part").orderBy(*order, size).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns(
        {"above": F.coalesce(F.sum(size).over(here), F.lit(0)), "nth": F.coalesce(F.count(F.lit(1)).over(here), F.lit(0))}
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base_rows"),
    )
    all_bytes = totals.agg(F.sum("bytes")).first()[0] or 1
    start = (F.col("base") + F.col("above")).cast("decimal(38,0)")
    # div keeps whole numbers, so equal cuts fall alike on every engine
    placed = inside.join(bases, "part").withColumns(
        {
            "start": start,
            "row": F.col("base_rows") + F.col("nth"),
        }
    )
    shard = F.expr(f"cast(start * {int(shards)} div {int(all_bytes)} as int)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(firsts, "shard").select(*df.columns, "shard", (F.col("row") - F.col("first")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    size: UTF-8 bytes of the text (null: none) plus 1.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = documents.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed = byte_shards(sized, shards, "doc_id", "text_crc32")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, folder: str, shards: int = 8) -> None:
    """Write whole documents to a folder per shard, rows of a shard in slot order per file."""
    places = shard_documents(documents, shards).select("doc_id", "size", "text_crc32", "shard", "slot").distinct()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = documents.withColumn("text_crc32", F.crc32(raw)).withColumn("size", (F.octet_length(raw) + 1).cast("long"))
    joined = keyed.join(places.dropDuplicates(["doc_id", "size", "text_crc32"]), ["doc_id", "size", "text_crc32"])
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("size", "text_crc32").write.partitionBy(
        "shard"
    ).parquet(folder)
