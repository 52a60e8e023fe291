"""Daily activity reports over half-open UTC intervals of local days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import patterns as P, timeops
from ..operators import evidence as ev

UNASSIGNED = "Unassociated activity"


def actor_groups(records: DataFrame, start: str, end: str | None, zone: str) -> DataFrame:
    """Records per project, provider, actor, session and worktree."""
    return (
        records.filter(timeops.within_days(F.col("event_time"), start, end, zone))
        .groupBy("project_id", "provider", "actor", "session_id", "worktree_id")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def project_totals(groups: DataFrame) -> DataFrame:
    """Records and distinct sessions per project, from the finer groups."""
    per_session = groups.groupBy("project_id", "session_id").agg(F.sum("records").alias("records"))
    return per_session.groupBy("project_id").agg(
        F.sum("records").alias("records"), F.count(F.lit(1)).alias("sessions")
    )


def commits(
    observations: DataFrame, worktrees: DataFrame, start: str, end: str | None, zone: str
) -> DataFrame:
    """Commits of the newest observation per worktree, dated inside the interval."""
    latest = ev.latest_observations(observations)
    trees = worktrees.select(F.col("worktree_id").alias("_w"), "project_id")
    at = timeops.event_time(F.col("commit.committer_time"))
    return (
        latest.join(trees, F.col("worktree_id") == F.col("_w"))
        .select("project_id", "worktree_id", "observed_at", F.explode_outer("data.commits").alias("commit"))
        .withColumn("committed_at", at)
        .filter(timeops.within_days(F.col("committed_at"), start, end, zone))
        .select("project_id", "worktree_id", "observed_at", "committed_at", "commit.revision", "commit.subject")
    )


def bucketed_items(resolved: DataFrame, start: str, end: str | None, zone: str) -> DataFrame:
    """Items of the interval, and earlier or undated work that is still open."""
    inside = timeops.within_days(F.col("event_time"), start, end, zone)
    before = F.col("event_time").isNull() | (F.col("event_time") < timeops.day_start(start, zone))
    carried = (
        F.col("kind").isin(P.ACTION_KINDS) & F.col("status").isin(P.CARRY_STATUSES) & before
    )
    bucket = F.when(inside, "activity").when(carried, "carryover")
    return resolved.filter(~F.col("status").isin(P.HIDDEN_STATUSES)).withColumn("bucket", bucket).filter(
        "bucket is not null"
    )


def ranked_items(
    resolved: DataFrame, start: str, end: str | None, zone: str, limit: int = 50
) -> DataFrame:
    """First `limit` items per project and bucket, with the bucket's total."""
    items = bucketed_items(resolved, start, end, zone)
    order = W.partitionBy("project_id", "bucket").orderBy(
        F.col("event_time").desc_nulls_last(), F.col("item_id").desc()
    )
    ranked = items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = items.groupBy(F.col("project_id").alias("_p"), F.col("bucket").alias("_b")).agg(
        F.count(F.lit(1)).alias("total")
    )
    return (
        ranked.join(totals, F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("bucket") == F.col("_b")))
        .drop("_p", "_b")
        .withColumn("omitted", F.greatest(F.lit(0), F.col("total") - limit))
    )


def project_days(
    records: DataFrame, resolved: DataFrame, projects: DataFrame, observations: DataFrame,
    worktrees: DataFrame, start: str, end: str | None, zone: str, limit: int = 50,
) -> DataFrame:
    """One row per project with activity or commits: counts, buckets and omissions."""
    totals = project_totals(actor_groups(records, start, end, zone))
    changed = commits(observations, worktrees, start, end, zone).groupBy(
        F.col("project_id").alias("c_project")
    ).agg(F.count(F.lit(1)).alias("commits"))
    seen = totals.join(changed, F.col("project_id").eqNullSafe(F.col("c_project")), "full_outer").select(
        F.coalesce("project_id", "c_project").alias("project_id"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("commits", F.lit(0)).alias("commits"),
    )
    counts = bucketed_items(resolved, start, end, zone).groupBy(F.col("project_id").alias("i_project")).agg(
        F.count_if(F.col("bucket") == "activity").alias("activity"),
        F.count_if(F.col("bucket") == "carryover").alias("carryover"),
    )
    names = projects.select(F.col("project_id").alias("n_project"), "name")
    over = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - limit)
    return (
        seen.join(counts, F.col("project_id").eqNullSafe(F.col("i_project")), "left")
        .join(names, F.col("project_id") == F.col("n_project"), "left")
        .select(
            "project_id",
            F.coalesce("name", F.lit(UNASSIGNED)).alias("name"),
            F.coalesce("name", F.lit("")).alias("sort_name"),
            "records", "sessions", "commits",
            F.coalesce("activity", F.lit(0)).alias("activity"),
            F.coalesce("carryover", F.lit(0)).alias("carryover"),
            over(F.col("activity")).alias("activity_omitted"),
            over(F.col("carryover")).alias("carryover_omitted"),
        )
    )


def day_spine(
    records: DataFrame, last_day: str, days: int, zone: str, project_id: str | None = None
) -> DataFrame:
    """Zero-filled records per local day for the `days` ending with `last_day`."""
    spark = records.sparkSession
    last = F.to_date(F.lit(last_day))
    spine = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    )
    first = F.date_sub(last, days - 1)
    rows = records.filter(
        (F.col("event_time") >= timeops.day_start(first, zone))
        & (F.col("event_time") < timeops.day_start(last, zone, 1))
    )
    if project_id:
        rows = rows.filter(F.col("project_id") == project_id)
    counts = rows.groupBy(timeops.local_day(F.col("event_time"), zone).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return spine.join(counts, F.col("day") == F.col("_day"), "left").select(
        "day", F.coalesce("_n", F.lit(0)).alias("records")
    )
