"""Recent context per project: what was last asked, done, reported and left uncertain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import patterns as P, textops
from ..operators import evidence as ev

WINDOW_ROWS = 60


def _newest(per: str, id_column: str = "record_id"):
    return W.partitionBy(per).orderBy(F.col("event_time").desc_nulls_last(), id_column)


def is_substantive(text: Column) -> Column:
    wrapper = text.rlike(P.EMPTY_WRAPPER_HEAD) & text.rlike(P.EMPTY_WRAPPER_TAIL)
    return text.rlike(r"(?U)\S") & ~textops.is_conversational(text) & ~wrapper


def recent_context(records: DataFrame, per: str = "project_id") -> DataFrame:
    """Newest rows per project that speak, return output, or mark an interruption."""
    speaks = F.col("actor").isin("user", "tool") | (
        (F.col("actor") == "assistant") & (F.col("kind") != "agent_proposal")
    )
    event = F.coalesce(F.col("event_type").isin(P.INTERRUPT_EVENTS), F.lit(False))
    rows = records.filter(
        F.col(per).isNotNull() & (F.col("provider") != P.PROVIDER_DOCUMENT) & (speaks | event)
    )
    return rows.withColumn("recency", F.row_number().over(_newest(per))).filter(
        F.col("recency") <= WINDOW_ROWS
    )


def latest_instruction(records: DataFrame, current_ids: DataFrame, per: str = "project_id") -> DataFrame:
    """Newest substantive one of all current user records per project."""
    said = records.filter(F.col(per).isNotNull() & (F.col("actor") == "user") & is_substantive(F.col("text"))).join(
        current_ids, "record_id", "left_semi"
    )
    newest_first = F.struct(F.col("event_time").isNull(), -F.unix_micros("event_time"), F.col("record_id"))
    return said.groupBy(per).agg(
        F.min_by(F.struct("record_id", "worktree_id", "event_time", "text"), newest_first).alias("_i")
    ).select(
        per, "_i.record_id", "_i.worktree_id", "_i.event_time",
        F.substring("_i.text", 1, 4000).alias("text"),
        F.greatest(F.lit(0), F.length("_i.text") - 4000).alias("omitted_chars"),
    )


def stopping_point(context: DataFrame, per: str = "project_id") -> DataFrame:
    said = context.filter(
        is_substantive(F.col("text")) & F.col("actor").isin("user", "assistant")
        & ~F.col("kind").isin("agent_proposal", "metadata")
    )
    return said.groupBy(per).agg(
        F.min_by(F.struct("record_id", "actor", "event_time", "text"), "recency").alias("_s")
    ).select(per, "_s.*")


def moved_stopping_point(stops: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A later supported directory move replaces the stopping point."""
    moved = verdicts.filter("project_id is not null").groupBy(F.col("project_id").alias("_p")).agg(
        F.max_by(F.struct("record_id", "event_time"), F.struct("event_time", "record_id")).alias("_m")
    )
    later = F.col("_m.event_time").isNotNull() & (
        F.col("event_time").isNull() | (F.col("_m.event_time") >= F.col("event_time"))
    )
    null = F.lit(None).cast("string")
    joined = stops.join(moved, F.col("project_id") == F.col("_p"), "full_outer")
    return joined.select(
        F.coalesce("project_id", "_p").alias("project_id"),
        F.when(later, F.col("_m.record_id")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(later, "tool").otherwise(F.col("actor")).alias("actor"),
        F.when(later, F.col("_m.event_time")).otherwise(F.col("event_time")).alias("event_time"),
        F.when(later, "Successful directory-move command recorded; project completion is unknown.")
        .otherwise(F.coalesce("text", null)).alias("text"),
    )


def agent_updates(context: DataFrame, instruction: DataFrame, per: str = "project_id", limit: int = 3) -> DataFrame:
    """Assistant reports at or after the latest instruction."""
    since = instruction.select(F.col(per).alias("_p"), F.col("event_time").alias("_since"), F.lit(1).alias("_has"))
    earliest = F.lit("0001-01-01").cast("timestamp")
    rows = context.filter((F.col("actor") == "assistant") & is_substantive(F.col("text"))).join(
        since, F.col(per) == F.col("_p"), "left"
    ).filter(
        F.col("_has").isNull() | (F.coalesce("event_time", earliest) >= F.coalesce("_since", earliest))
    )
    order = W.partitionBy(per).orderBy("recency")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        per, "rank", "record_id", "event_time",
        F.substring("text", 1, 900).alias("text"),
        F.greatest(F.lit(0), F.length("text") - 900).alias("omitted_chars"),
    )


def result_excerpt(text: Column) -> Column:
    """Last status-like lines of recorded output."""
    lines = F.split(text, "\n")
    tail = F.reverse(F.slice(F.reverse(lines), 1, 100))
    decoded = lambda line: F.try_parse_json(line)
    output = lambda line: F.coalesce(
        F.try_variant_get(decoded(line), "$.value.output", "string"),
        F.try_variant_get(decoded(line), "$.output", "string"),
    )
    last80 = lambda value: F.reverse(F.slice(F.reverse(F.split(value, "\n")), 1, 80))
    none = F.array().cast("array<string>")
    expanded = F.flatten(
        F.transform(
            tail,
            lambda line: F.when(line.startswith("{"), F.coalesce(last80(output(line)), none)).otherwise(
                F.array(line)
            ),
        )
    )
    chosen = F.filter(
        expanded,
        lambda line: (F.length(line) <= 500) & line.rlike(P.ci(P.STATUS_OUTPUT)) & ~line.rlike(P.cs(P.SOURCE_CODE_OUTPUT)),
    )
    return F.array_join(F.reverse(F.slice(F.reverse(chosen), 1, 6)), "\n")


def recent_results(context: DataFrame, per: str = "project_id", limit: int = 3) -> DataFrame:
    """Newest tool results with status lines, as excerpts."""
    rows = context.filter("kind = 'recorded_tool_result'").withColumn("excerpt", result_excerpt(F.col("text")))
    order = W.partitionBy(per).orderBy("recency")
    return rows.filter("excerpt <> ''").withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= limit
    ).select(per, "rank", "record_id", "event_time", "revision", "exit_status", "excerpt")


def recorded_facts(context: DataFrame) -> DataFrame:
    """Revisions stated by the records of the window."""
    return context.filter("revision is not null").select(
        "project_id", "worktree_id", "record_id", "event_time", "revision", "recency", "text"
    )


def recorded_evidence(context: DataFrame) -> DataFrame:
    return context.filter("kind = 'recorded_tool_result'").select(
        "project_id", "worktree_id", "record_id", "event_time", "revision", "exit_status", "text"
    )


_UNCERTAINTY = ["project_id", "code", "record_id", "related_record_id"]


def uncertainties(
    context: DataFrame, selected_items: DataFrame, observations: DataFrame, source_states: DataFrame
) -> DataFrame:
    """Coded doubts per project: project_id, code, record_id, related_record_id, detail.

    The context is a bounded window per project, so the joins per worktree are small.
    """
    null = F.lit(None).cast("string")
    row = lambda code, detail=null, related=null: [
        "project_id", code.alias("code"), "record_id", related.alias("related_record_id"), detail.alias("detail"),
    ]
    times = context.filter("time_status <> 'known'").select(
        *row(F.when(F.col("time_status") == "naive", "naive_timestamp").otherwise("unknown_timestamp"))
    )
    events = context.filter(F.col("event_type").isin(P.INTERRUPT_EVENTS)).select(
        *row(F.when(F.col("event_type") == "turn_aborted", "interrupted_source").otherwise("source_event"),
             F.col("event_type"))
    )
    unclear = context.filter(textops.matches(F.col("text"), P.AMBIGUOUS)).select(
        *row(F.lit("ambiguous_path_reference"))
    )
    newest = recorded_facts(context).groupBy(
        F.col("project_id").alias("_p"), F.col("worktree_id").alias("_w")
    ).agg(F.min_by(F.struct("revision", "record_id"), "recency").alias("_latest"))
    heads = ev.latest_observations(observations).select(
        F.col("worktree_id").alias("_hw"), F.col("data.head").alias("_head")
    )
    captured = (
        recorded_evidence(context)
        .join(newest, F.col("project_id").eqNullSafe(F.col("_p")) & F.col("worktree_id").eqNullSafe(F.col("_w")), "left")
        .join(heads, F.col("worktree_id") == F.col("_hw"), "left")
    )
    other = F.col("_latest.revision") != F.col("revision")
    elsewhere = F.col("_head") != F.col("revision")
    stale = F.coalesce(other, F.lit(False)) | F.coalesce(elsewhere, F.lit(False))
    code = F.when(F.col("revision").isNull(), "unknown_verification_scope").when(stale, "stale_verification")
    verification = captured.withColumn("_code", code).filter("_code is not null").select(
        *row(F.col("_code"), F.col("revision"), F.when(F.coalesce(other, F.lit(False)), F.col("_latest.record_id")))
    )
    claims = selected_items.filter((F.col("kind") == "claim") & (F.col("category") == "agent_claim")).select(
        *row(F.lit("unverified_claim"))
    )
    unresolved = selected_items.filter("resolution_uncertainty is not null").select(
        *row(F.lit("unresolved_correction"), F.col("resolution_uncertainty"))
    )
    gaps = source_states.filter("source_status <> 'ready'").select(
        "project_id",
        F.when(F.col("source_status") == "missing", "unavailable_source").otherwise("incomplete_source").alias("code"),
        null.alias("record_id"), null.alias("related_record_id"), F.col("source_id").alias("detail"),
    )
    out = times
    for part in (events, unclear, verification, claims, unresolved, gaps):
        out = out.unionByName(part)
    return out


def next_actions(selected_items: DataFrame, worktrees: DataFrame, limit: int = 5) -> DataFrame:
    """Open next actions, then tasks, of the selected items (which carry `rank`)."""
    actions = selected_items.filter(
        F.col("kind").isin("next_action", "task") & F.col("status").isin(P.OPEN_STATUSES)
    )
    order = W.partitionBy("project_id").orderBy((F.col("kind") != "next_action").asc(), "rank")
    first = actions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    present = worktrees.filter("active").select(F.col("worktree_id").alias("_w")).distinct()
    category = (
        F.when(F.col("category") == "documented_pending", "documented_pending")
        .when(F.col("actor") == "assistant", "reported_pending").otherwise("recorded_instruction")
    )
    return first.join(present, F.col("worktree_id") == F.col("_w"), "left").select(
        "project_id", "place", "item_id", "record_id", "worktree_id", "text", "status", "priority",
        category.alias("action_category"),
        F.when(F.col("_w").isNotNull(), "current").otherwise("worktree_unavailable_verify_location").alias("availability"),
    )


def combined_actions(
    pending: DataFrame, actions: DataFrame, worktrees: DataFrame, instruction: DataFrame,
    conflicted: DataFrame, limit: int = 5,
) -> DataFrame:
    """Documented pending work first, then recorded actions; a procedure change leads.

    `pending` holds facet rows with evidence_status and places_not_ready;
    `conflicted` the project ids with conflicts.
    """
    present = worktrees.filter("active").select(F.col("worktree_id").alias("_w")).distinct()
    documented = pending.join(present, F.col("worktree_id") == F.col("_w"), "left").select(
        "project_id", F.lit(1).alias("tier"), F.col("facet_rank").alias("place"), "record_id", "worktree_id", "text",
        F.lit("documented_pending").alias("action_category"),
        F.when(F.col("evidence_status") != "current", "source_unavailable_last_known_pending")
        .when(F.col("places_not_ready") > 0, "source_partial_last_known_pending")
        .when(F.col("_w").isNotNull(), "current")
        .otherwise("worktree_unavailable_verify_location").alias("availability"),
    )
    has_pending = documented.select(F.col("project_id").alias("_dp")).distinct()
    rest = actions.join(has_pending, F.col("project_id") == F.col("_dp"), "left").filter(
        F.col("_dp").isNull() | (F.col("action_category") != "documented_pending")
    ).select(
        "project_id", F.lit(2).alias("tier"), "place", "record_id", "worktree_id", "text", "action_category", "availability"
    )
    text = F.col("text")
    change = instruction.filter(
        textops.matches(text, P.PROCEDURE_VERB) & textops.matches(text, P.PROCEDURE_NOUN)
    ).join(has_pending, F.col("project_id") == F.col("_dp"), "left_semi").join(
        conflicted.select(F.col("project_id").alias("_cp")).distinct(), F.col("project_id") == F.col("_cp"), "left_semi"
    ).select(
        "project_id", F.lit(0).alias("tier"), F.lit(0).alias("place"), "record_id", "worktree_id", "text",
        F.lit("recorded_instruction").alias("action_category"),
        F.lit("reconcile_documented_procedure_with_explicit_instruction").alias("availability"),
    )
    changed = change.select(F.col("project_id").alias("_chp"))
    union = documented.unionByName(rest).unionByName(change).join(
        changed, F.col("project_id") == F.col("_chp"), "left"
    ).filter(F.col("_chp").isNull() | (F.col("tier") < 2)).withColumn(
        "availability",
        F.when(F.col("_chp").isNotNull() & (F.col("tier") == 1), "documented_pending_check_procedure_change")
        .otherwise(F.col("availability")),
    )
    order = W.partitionBy("project_id").orderBy("tier", "place", "record_id")
    return union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_chp", "tier", "place")


def procedure_changes(instruction: DataFrame) -> DataFrame:
    """Latest instructions that change the procedure; listed before other conflicts."""
    return instruction.filter(textops.matches(F.col("text"), P.PROCEDURE_CHANGE)).select(
        "project_id", F.lit("procedure_change").alias("code"), "record_id"
    )
