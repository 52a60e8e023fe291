"""Where records come from, and whether those places are still current.

A record may occur any number of times, so places stay rows; summaries keep
counts and the first place only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pathops, patterns as P


def current_record_ids(occurrences: DataFrame, generations: DataFrame) -> DataFrame:
    """Records with an occurrence in a current generation (source status ignored)."""
    current = generations.filter("status = 'current'").select("generation_id")
    return (
        occurrences.select("record_id", "generation_id")
        .join(current, "generation_id", "left_semi")
        .select("record_id")
        .distinct()
    )


def locations(occurrences: DataFrame, generations: DataFrame, sources: DataFrame) -> DataFrame:
    """Every place of every record with its generation and source status."""
    place = generations.select(
        "generation_id", "source_id", F.col("number").alias("generation"),
        F.col("status").alias("generation_status"),
    ).join(
        sources.select("source_id", "path", F.col("status").alias("source_status")), "source_id"
    )
    return occurrences.join(place, "generation_id").select(
        "record_id", "source_id", "path", "source_status", "generation", "generation_status", "locator"
    )


def is_live() -> Column:
    return (F.col("generation_status") == "current") & F.col("source_status").isin(
        P.LIVE_SOURCE_STATUSES
    )


def summarize(located: DataFrame) -> DataFrame:
    """Per record: places, sources not ready, whether any place is live, and the first place."""
    return located.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("places"),
        F.count_if(F.col("source_status") != "ready").alias("places_not_ready"),
        F.bool_or(is_live()).alias("live"),
        F.min(F.struct("path", "generation", "locator")).alias("first_place"),
    )


def evidence(records: DataFrame, located: DataFrame) -> DataFrame:
    """Evidence of each record; no place, or none live, means missing_or_superseded."""
    s = summarize(located).withColumnRenamed("record_id", "_rid")
    joined = records.join(s, records.record_id == s._rid, "left")
    fields = [
        c for c in (
            "record_id", "provider", "session_id", "native_id", "actor", "event_time",
            "time_status", "kind", "metadata",
        ) if c in records.columns
    ]
    return joined.select(
        *fields,
        F.coalesce("places", F.lit(0)).alias("places"),
        F.coalesce("places_not_ready", F.lit(0)).alias("places_not_ready"),
        F.col("first_place.path").alias("first_path"),
        F.col("first_place.locator").alias("first_locator"),
        F.when(F.coalesce("live", F.lit(False)), "current")
        .otherwise("missing_or_superseded")
        .alias("evidence_status"),
    )


def evidence_status(wanted: DataFrame, records: DataFrame, located: DataFrame) -> DataFrame:
    """Status of asked-for record ids, including ids no longer present."""
    known = evidence(records, located).select(F.col("record_id").alias("_rid"), "evidence_status")
    return (
        wanted.join(known, wanted.record_id == known._rid, "left")
        .drop("_rid")
        .withColumn("evidence_status", F.coalesce("evidence_status", F.lit("removed_or_unknown")))
    )


def project_sources(
    records: DataFrame, occurrences: DataFrame, generations: DataFrame, sources: DataFrame
) -> DataFrame:
    """Distinct sources that hold a project's records, with their status."""
    # Reduce to (project, generation) before touching the dimension tables.
    touched = (
        occurrences.select("record_id", "generation_id")
        .join(records.select("record_id", "project_id"), "record_id")
        .groupBy("project_id", "generation_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        touched.join(generations.select("generation_id", "source_id"), "generation_id")
        .select("project_id", "source_id")
        .distinct()
        .join(sources.select("source_id", "path", F.col("status").alias("source_status")), "source_id")
    )


def sessions_of_sources(
    records: DataFrame, occurrences: DataFrame, generations: DataFrame, sources: DataFrame,
    excluded_glob: str,
) -> DataFrame:
    """Sessions reachable from sources whose path or file name matches the exclusion."""
    regex = pathops.file_glob(excluded_glob)
    hit = sources.filter(
        F.col("path").rlike(regex) | pathops.base_name(F.col("path")).rlike(regex)
    ).select("source_id")
    gens = generations.join(hit, "source_id", "left_semi").select("generation_id")
    ids = occurrences.join(gens, "generation_id", "left_semi").select("record_id")
    return records.join(ids, "record_id", "left_semi").select("session_id").distinct()


def latest_observations(observations: DataFrame) -> DataFrame:
    """Newest observation per worktree."""
    return observations.groupBy("worktree_id").agg(
        F.max("observation_id").alias("observation_id"),
        F.max_by("observed_at", "observation_id").alias("observed_at"),
        F.max_by("data", "observation_id").alias("data"),
    )
