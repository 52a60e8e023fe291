"""Coverage, sessions, projects, memory, activity and integrity views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashing, patterns as P, textops
from ..operators import evidence as ev, resolve


# --- coverage -------------------------------------------------------------------


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("status").agg(F.count(F.lit(1)).alias("sources"))


def source_list(sources: DataFrame, limit: int | None = 50, ready_first: bool = False) -> DataFrame:
    ready = (F.col("status") == "ready")
    order = [ready.desc() if ready_first else ready.asc(), F.col("provider"), F.col("path")]
    out = sources.orderBy(*order)
    return out if limit is None else out.limit(limit)


def record_gaps(records: DataFrame) -> DataFrame:
    """Unattributed records and unknown event times, in one pass."""
    return records.agg(
        F.count_if(F.col("project_id").isNull() & (F.col("text") != "")).alias("unassociated_records"),
        F.count_if(
            (F.col("time_status") != "known") & (F.col("provider") != P.PROVIDER_DOCUMENT)
        ).alias("unknown_event_times"),
    )


def coverage_status(
    refresh_runs: DataFrame, scope_changed: bool = False, source_missing: bool = False
) -> DataFrame:
    """Latest run with the status a reader should assume."""
    latest = refresh_runs.agg(F.max_by(F.struct("*"), "run_id").alias("run"))
    status = (
        F.when(F.col("run").isNull(), "not_refreshed")
        .when(F.lit(scope_changed), "refresh_required")
        .when(F.lit(source_missing), "partial")
        .otherwise(F.col("run.status"))
    )
    return latest.select(F.col("run.run_id").alias("run_id"), status.alias("coverage_status"))


def diagnostic_histogram(diagnostics: DataFrame, limit: int = 8) -> DataFrame:
    note = F.concat(F.coalesce("code", F.lit("unknown")), F.lit(": "), F.coalesce("message", F.lit("")))
    return (
        diagnostics.groupBy(note.alias("note")).agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy("note").limit(limit)
    )


def source_diagnostics(diagnostics: DataFrame, limit: int = P.MAX_SOURCE_DIAGNOSTICS) -> DataFrame:
    """The first diagnostics of each source, as its status line shows them."""
    order = W.partitionBy("source_id").orderBy("line_no", "code")
    return diagnostics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


# --- sessions and projects --------------------------------------------------------


def recent_sessions(records: DataFrame, per: str = "project_id", limit: int = 20) -> DataFrame:
    grouped = records.filter(F.col(per).isNotNull()).groupBy(per, "session_id").agg(
        F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("records")
    )
    order = W.partitionBy(per).orderBy(F.col("last_event").desc_nulls_last(), F.col("session_id"))
    return grouped.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def session_page(
    sessions: DataFrame, records: DataFrame, page: int = 50,
    before: str | None = None, after: str | None = None,
) -> DataFrame:
    """Keyset page with one extra row that tells whether more follow."""
    chosen = sessions
    if before is not None:
        chosen = chosen.filter(F.col("session_id") < before)
    elif after is not None:
        chosen = chosen.filter(F.col("session_id") > after)
    order = F.col("session_id").asc() if after is not None else F.col("session_id").desc()
    wanted = chosen.orderBy(order).limit(page + 1)
    counts = (
        records.select(F.col("session_id").alias("_sid"), "event_time")
        .join(wanted.select(F.col("session_id").alias("_sid")), "_sid", "left_semi")
        .groupBy("_sid").agg(F.count(F.lit(1)).alias("_n"), F.max("event_time").alias("_last"))
    )
    return wanted.join(counts, F.col("session_id") == F.col("_sid"), "left").select(
        *sessions.columns, F.coalesce("_n", F.lit(0)).alias("records"), F.col("_last").alias("last_event")
    )


def session_detail(records: DataFrame, located: DataFrame, value: str, limit: int = 50) -> DataFrame:
    """Newest records of the one session with this id or native id."""
    mine = records.filter((F.col("session_id") == value) | (F.col("session_native_id") == value))
    if len(mine.select("session_id").distinct().limit(2).collect()) != 1:
        raise ValueError("session_not_found_or_ambiguous")
    newest = mine.orderBy(F.col("event_time").desc_nulls_last(), "record_id").limit(limit)
    status = ev.evidence(newest, located).select(
        F.col("record_id").alias("_rid"), "evidence_status", "places"
    )
    return newest.join(status, F.col("record_id") == F.col("_rid")).drop("_rid")


def project_view(
    projects: DataFrame, worktrees: DataFrame, observations: DataFrame, records: DataFrame
) -> DataFrame:
    """One row per worktree of each project with its latest observation."""
    latest = ev.latest_observations(observations).select(
        F.col("worktree_id").alias("_w"), "observed_at", F.col("data.branch").alias("branch"),
        F.col("data.head").alias("head"), F.col("data.available").alias("available"),
        F.size("data.status").alias("dirty_entries"),
    )
    trees = worktrees.join(latest, F.col("worktree_id") == F.col("_w"), "left").drop("_w")
    counts = records.groupBy(F.col("project_id").alias("_p")).agg(F.count(F.lit(1)).alias("records"))
    return (
        projects.select("project_id", "name").join(trees, "project_id", "left")
        .join(counts, F.col("project_id") == F.col("_p"), "left")
        .drop("_p").withColumn("records", F.coalesce("records", F.lit(0)))
    )


# --- items -------------------------------------------------------------------------


def tasks(resolved: DataFrame, limit: int = 100, per: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return resolve.rank_items(
        resolve.select_items(resolved, P.TASK_VIEW_KINDS), limit, prioritize_active=True, per=per
    )


def decisions(resolved: DataFrame, limit: int = 100, per: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return resolve.rank_items(resolve.select_items(resolved, ["decision"]), limit, per=per)


def objectives(resolved: DataFrame) -> DataFrame:
    """Newest user objective per project that is still active or accepted."""
    live = resolved.filter(
        (F.col("kind") == "objective") & (F.col("actor") == "user")
        & F.col("status").isin("active", "accepted")
    )
    best = F.struct(F.col("event_time").isNotNull(), "event_time", "item_id")
    return live.groupBy("project_id").agg(
        F.max_by(F.struct("item_id", "record_id", "worktree_id", "text", "status"), best).alias("_o")
    ).select("project_id", "_o.*")


# --- memory -------------------------------------------------------------------------


def current_memory(changes: DataFrame) -> DataFrame:
    """Latest version of each entry of the append-only change log."""
    fields = [c for c in changes.columns if c != "memory_id"]
    order = F.struct("updated_at", "status", "text")
    return changes.groupBy("memory_id").agg(
        F.max_by(F.struct(*fields), order).alias("_m"), F.min("created_at").alias("_created")
    ).select("memory_id", "_m.*", "_created").withColumn("created_at", F.col("_created")).drop("_created")


def validate_memory(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Rows that may not be added, with the reason."""
    refs = entries.select("memory_id", F.explode_outer("refs").alias("ref")).filter("ref is not null")
    unknown = refs.join(
        records.select(F.col("record_id").alias("ref")), "ref", "left_anti"
    ).select("memory_id", F.lit("memory_reference_must_be_known_record_id").alias("error"))
    bad = entries.select(
        "memory_id",
        F.when(
            ~F.col("kind").isin(P.MEMORY_KINDS) | ~F.col("origin").isin("explicit", "inferred"),
            "invalid_memory_kind_or_origin",
        )
        .when((F.col("origin") == "inferred") & (F.col("status") != "proposed"), "inferred_memory_must_start_proposed")
        .when(~F.col("status").isin(P.VALID_STATUSES), "invalid_status").alias("error"),
    ).filter("error is not null")
    return unknown.unionByName(bad).distinct()


def add_memory(
    spark, kind: str, text: str, at: Column, scope: str = "global", origin: str = "explicit",
    refs: list[str] | None = None, status: str | None = None, reason: str = "",
) -> DataFrame:
    """One new change-log row; inferred entries start as proposals."""
    null = F.lit(None).cast("string")
    state = status or ("proposed" if origin == "inferred" else "accepted")
    return spark.range(1).select(
        hashing.content_id(F.lit("memory"), F.lit(kind), F.lit(text), F.lit(scope), at).alias("memory_id"),
        F.lit(kind).alias("kind"), textops.redact(F.lit(text)).alias("text"), F.lit(state).alias("status"),
        F.lit(origin).alias("origin"), F.lit(scope).alias("scope"),
        F.array(*[F.lit(r) for r in refs or []]).cast("array<string>").alias("refs"),
        textops.redact(F.lit(reason)).alias("reason"), at.alias("created_at"), at.alias("updated_at"),
        null.alias("supersedes"), null.alias("exceptions"), null.alias("conflicts"),
    )


def update_memory(
    current: DataFrame, memory_id: str, at: Column, status: str | None = None, text: str | None = None,
    reason: str = "User edit", supersedes: str | None = None,
) -> DataFrame:
    """Change-log rows for an edit, and for the entry it supersedes."""
    if status is not None and status not in P.VALID_STATUSES:
        raise ValueError("invalid_status")
    edited = current.filter(F.col("memory_id") == memory_id).withColumns(
        {
            "status": F.lit(status) if status else F.col("status"),
            "text": textops.redact(F.lit(text)) if text else F.col("text"),
            "reason": textops.redact(F.lit(reason)),
            "supersedes": F.lit(supersedes) if supersedes else F.col("supersedes"),
            "updated_at": at,
        }
    )
    if not supersedes:
        return edited
    older = current.filter(F.col("memory_id") == supersedes).withColumns(
        {"status": F.lit("superseded"), "updated_at": at}
    )
    return edited.unionByName(older)


def audit_rows(changes: DataFrame, action: str) -> DataFrame:
    return changes.select(
        F.lit(action).alias("action"), F.col("memory_id").alias("target"), F.col("updated_at").alias("at"),
        F.to_json(F.struct("status", "reason")).alias("details"),
    )


def accepted_memory(memory: DataFrame, project_id: str) -> DataFrame:
    return memory.filter(
        F.col("scope").isin("global", project_id) & (F.col("status") == "accepted") & (F.col("kind") != "principle")
    ).orderBy(F.col("updated_at").desc(), "memory_id")


def principles(memory: DataFrame, scope: str | None = None, accepted_only: bool = False) -> DataFrame:
    rows = memory.filter("kind = 'principle'")
    if scope:
        rows = rows.filter(F.col("scope").isin("global", scope))
    if accepted_only:
        rows = rows.filter("status = 'accepted'")
    confidence = (
        F.when(F.col("origin") == "explicit", "explicit")
        .when(F.col("status") == "accepted", "accepted_inference; origin remains inferred")
        .otherwise("proposal_only; requires acceptance")
    )
    return rows.withColumn("confidence", confidence)


def memory_evidence(memory: DataFrame, records: DataFrame, located: DataFrame) -> DataFrame:
    """Evidence status of every reference, in the order given."""
    refs = memory.select(
        "memory_id", F.posexplode_outer("refs").alias("position", "record_id")
    ).filter("record_id is not null")
    return ev.evidence_status(refs, records, located)


# --- corrections and mappings -------------------------------------------------------


def correction_errors(corrections: DataFrame, items: DataFrame) -> DataFrame:
    known = items.select(F.col("item_id").alias("target")).unionByName(
        items.select(F.col("record_id").alias("target"))
    )
    lost = corrections.join(known, "target", "left_anti").select(
        "correction_id", F.lit("correction_target_not_found_use_item_or_record_id").alias("error")
    )
    empty = corrections.select(
        "correction_id",
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(P.VALID_STATUSES), "invalid_status")
        .when(F.col("status").isNull() & F.col("text").isNull(), "correction_requires_text_or_status")
        .alias("error"),
    ).filter("error is not null")
    return lost.unionByName(empty)


def recent_mappings(associations: DataFrame, limit: int = 20) -> DataFrame:
    order = W.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("association_id").desc())
    return associations.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


# --- activity, counts, integrity -----------------------------------------------------


def activity_stats(activity: DataFrame, now: Column) -> DataFrame:
    """Calls, failures and mean duration of the last 24 hours."""
    return activity.filter(F.col("at") > now - F.expr("interval 24 hours")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") != "ok").alias("failures"),
        F.avg("duration_ms").alias("mean_ms"),
    )


def activity_page(activity: DataFrame, page: int = 50, before: int | None = None, after: int | None = None) -> DataFrame:
    rows = activity
    if before is not None:
        rows = rows.filter(F.col("activity_id") < before)
    elif after is not None:
        rows = rows.filter(F.col("activity_id") > after)
    order = F.col("activity_id").asc() if after is not None else F.col("activity_id").desc()
    return rows.orderBy(order).limit(page + 1)


def hourly_activity(activity: DataFrame) -> DataFrame:
    """Rolling 24 h windows every hour per tool; batch twin of the stream.

    Calls are summed per hour first, and only those sums spread over the windows.
    """
    hours = activity.groupBy(F.date_trunc("hour", "at").alias("hour"), "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") != "ok").alias("failures"),
        F.sum("duration_ms").alias("total_ms"),
    )
    starts = F.sequence(F.col("hour") - F.expr("interval 23 hours"), F.col("hour"), F.expr("interval 1 hour"))
    spread = hours.filter("hour is not null").withColumn("window_start", F.explode(starts))
    return spread.groupBy("window_start", "tool").agg(
        *[F.sum(c).alias(c) for c in ("calls", "failures", "total_ms")]
    )


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("entity"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_records(records: DataFrame) -> DataFrame:
    """Native records present more than once."""
    return (
        records.groupBy("session_id", "native_id", "actor", "kind")
        .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans per foreign key: (child, key, parent) -> rows without a parent."""
    keys = [
        ("items", "record_id", "records", "record_id"),
        ("occurrences", "record_id", "records", "record_id"),
        ("occurrences", "generation_id", "generations", "generation_id"),
        ("generations", "source_id", "sources", "source_id"),
        ("worktrees", "project_id", "projects", "project_id"),
    ]
    out = None
    for child, key, parent, parent_key in keys:
        if child not in tables or parent not in tables:
            continue
        orphans = tables[child].select(F.col(key).alias("_k")).join(
            tables[parent].select(F.col(parent_key).alias("_k")), "_k", "left_anti"
        ).agg(F.count(F.lit(1)).alias("orphans"))
        one = orphans.select(
            F.lit(f"{child}.{key}").alias("check"), "orphans",
            F.when(F.col("orphans") == 0, "passed").otherwise("failed").alias("status"),
        )
        out = one if out is None else out.unionByName(one)
    return out
