"""Forgetting sessions and finding the ones past retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timeops


def retention_candidates(records: DataFrame, before: str, zone: str) -> DataFrame:
    """Sessions whose last event precedes the day and which have no unknown times."""
    return (
        records.groupBy("session_id")
        .agg(
            F.max("event_time").alias("last_event"),
            F.count_if(F.col("time_status") != "known").alias("unknown_times"),
            F.count(F.lit(1)).alias("records"),
        )
        .filter((F.col("last_event") < timeops.day_start(before, zone)) & (F.col("unknown_times") == 0))
    )


def tombstones(sessions: DataFrame, forgotten_sessions: DataFrame, at: Column) -> DataFrame:
    """Rows that keep the sessions from being imported again."""
    return sessions.join(forgotten_sessions.select("session_id"), "session_id", "left_semi").select(
        "provider", F.col("native_id").alias("session_native_id"), at.alias("created_at")
    ).distinct()


def forget(tables: dict[str, DataFrame], forgotten_sessions: DataFrame) -> dict[str, DataFrame]:
    """Tables without the sessions' records and what hangs on them; memory stays."""
    gone = forgotten_sessions.select("session_id").distinct()
    removed = tables["records"].join(gone, "session_id", "left_semi").select("record_id")
    out = dict(tables)
    out["records"] = tables["records"].join(gone, "session_id", "left_anti")
    if "sessions" in tables:
        out["sessions"] = tables["sessions"].join(gone, "session_id", "left_anti")
    for name in ("items", "occurrences"):
        if name in tables:
            out[name] = tables[name].join(removed, "record_id", "left_anti")
    if "associations" in tables:
        targets = removed.select(F.col("record_id").alias("target")).unionByName(
            gone.select(F.col("session_id").alias("target"))
        )
        out["associations"] = tables["associations"].join(targets, "target", "left_anti")
    return out


def excluded_cascade(tables: dict[str, DataFrame], excluded_glob: str) -> dict[str, DataFrame]:
    """Forget every session reachable from sources that match the exclusion."""
    from ..operators import evidence as ev

    sessions = ev.sessions_of_sources(
        tables["records"], tables["occurrences"], tables["generations"], tables["sources"], excluded_glob
    )
    return forget(tables, sessions)
