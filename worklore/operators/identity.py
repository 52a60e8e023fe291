"""Record identity, provenance fan-out, session dimension, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import hashing


def distinct_records(occurring: DataFrame, columns: list[str]) -> DataFrame:
    """One row per record id.  Copies agree on every identity column."""
    return occurring.select(*columns).dropDuplicates(["record_id"])


def distinct_occurrences(occurring: DataFrame) -> DataFrame:
    return occurring.select("record_id", "generation_id", "locator", "position").dropDuplicates(
        ["record_id", "generation_id", "locator"]
    )


def sessions_of(records: DataFrame) -> DataFrame:
    """The (provider, native id) session dimension."""
    return records.select("provider", "session_native_id").distinct().select(
        hashing.content_id(F.col("provider"), F.col("session_native_id")).alias("session_id"),
        "provider", F.col("session_native_id").alias("native_id"),
    )


def without_forgotten(records: DataFrame, forgotten: DataFrame) -> DataFrame:
    return records.join(
        forgotten.select("provider", "session_native_id").distinct(),
        ["provider", "session_native_id"],
        "left_anti",
    )


def forgotten_records(records: DataFrame, forgotten: DataFrame) -> DataFrame:
    return records.join(
        forgotten.select("provider", "session_native_id").distinct(),
        ["provider", "session_native_id"],
        "left_semi",
    )


COPY_FIELDS = [
    "session_id", "role", "content", "timestamp", "tool_call_id", "tool_calls", "tool_name",
]


def without_copies(messages: DataFrame) -> DataFrame:
    """Visible chat rows; among equal ones the highest active, then the highest id.

    A rank of one is cut before the shuffle, so copies do not travel.
    """
    visible = messages.filter((F.col("active") == 1) | (F.col("compacted") == 1))
    w = W.partitionBy(*COPY_FIELDS).orderBy(F.col("active").desc(), F.col("id").desc())
    return visible.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def generation_status(generations: DataFrame) -> DataFrame:
    """The highest generation of a source is current, the others superseded."""
    newest = generations.groupBy(F.col("source_id").alias("_sid")).agg(
        F.max("number").alias("_newest")
    )
    return (
        generations.drop("status")
        .join(newest, F.col("source_id") == F.col("_sid"))
        .withColumn("status", F.when(F.col("number") == F.col("_newest"), "current").otherwise("superseded"))
        .drop("_sid", "_newest")
    )


def carry_overrides(old_items: DataFrame, new_items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections copied to a re-extracted item whose text had exactly one predecessor."""
    single = (
        old_items.groupBy("record_id", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("old_id"))
        .filter("n = 1")
    )
    moved = (
        new_items.select("item_id", "record_id", "text")
        .join(single, ["record_id", "text"])
        .filter("item_id <> old_id")
        .select(F.col("item_id").alias("new_id"), "old_id")
    )
    copied = corrections.join(moved, corrections.target == moved.old_id).select(
        hashing.content_id(F.lit("carried"), F.col("correction_id"), F.col("new_id")).alias("correction_id"),
        F.col("new_id").alias("target"),
        *[c for c in corrections.columns if c not in ("correction_id", "target")],
    )
    return corrections.unionByName(copied).dropDuplicates(["correction_id"])
