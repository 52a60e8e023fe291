"""Attribution by recorded directory moves and by observed identity intervals.

Every rule is decided from per-key minima/maxima and the next execution of the
session, so no move is compared with all rows of its session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import session
from ..functions import ordering, pathops, patterns as P
from ..functions.plans import settle

_SESSION = ["session_id", "generation_id"]


def _with_words(runs: DataFrame) -> DataFrame:
    """Adds `words` of a single plain command (columns command, argv); NULL for anything a shell would interpret."""
    shell = F.coalesce(F.get("argv", F.lit(0)).isin(P.SHELLS), F.lit(False))
    script = F.when(
        F.col("_shell"),
        F.when((F.size("argv") == 3) & F.get("argv", F.lit(1)).isin("-c", "-lc"), F.get("argv", F.lit(2))),
    ).otherwise(F.when(F.col("argv").isNull(), F.col("command")))
    plain = F.when(~F.col("_script").rlike(P.SHELL_METACHARACTERS), F.split(F.btrim("_script"), r"\s+"))
    words = F.when(F.col("argv").isNotNull() & ~F.col("_shell"), F.col("argv")).otherwise(plain)
    said = runs.withColumn("_shell", shell).withColumn("_script", script).withColumn("_words", words)
    few = (F.size("_words") > 0) & (F.size("_words") <= 8)
    return said.withColumn("words", F.when(few, F.col("_words"))).drop("command", "argv", "_shell", "_script", "_words")


def _with_arguments(runs: DataFrame) -> DataFrame:
    """Adds what follows the options of a move (`_ends`, `_old`, `_new`) and of a root query (`_asked`, `_at`, `_output`).

    Both stay NULL for any other command: the long expressions on paths are for these only.
    """
    first = F.get("words", F.lit(0))
    rest = lambda c, at: F.slice(c, F.lit(at), F.lit(8))
    args = F.col("_args")
    elsewhere = F.coalesce(F.get(args, F.lit(0)) == "-C", F.lit(False))
    runs = runs.withColumn("_move", first.isin(P.MOVE_COMMANDS)).withColumn("_query", first.isin(P.ROOT_COMMANDS))
    runs = runs.withColumn("_args", F.when(F.col("_move") | F.col("_query"), rest("words", 2)))
    runs = runs.withColumn("_flagless", F.when(F.get(args, F.lit(0)).isin("-n", "--no-clobber"), rest(args, 2)).otherwise(args))
    runs = runs.withColumn("_bare", F.when(F.get("_flagless", F.lit(0)) == "--", rest("_flagless", 2)).otherwise(F.col("_flagless")))
    runs = runs.withColumn("_two", F.col("_move") & (F.size("_bare") == 2))
    return runs.withColumns({
        "_old": F.when(F.col("_two"), F.get("_bare", F.lit(0))), "_new": F.when(F.col("_two"), F.get("_bare", F.lit(1))),
        "_asked": F.when(F.col("_query"), F.array_join(F.when(elsewhere, rest(args, 3)).otherwise(args), " ")),
        "_at": F.when(F.col("_query"), F.when(elsewhere, F.get(args, F.lit(1))).otherwise(F.col("cwd"))),
        "_output": F.when(F.col("_query"), F.regexp_replace("text", r"\n\z", "")),
    }).drop("_args", "_flagless", "_bare", "_two", "_move", "_query")


def _move_paths(old: Column, new: Column) -> Column:
    return F.when(
        old.isNotNull() & new.isNotNull() & (old != new) & (pathops.parent(old) == pathops.parent(new)),
        F.struct(old.alias("old"), new.alias("new")),
    )


def _root_path(asked: Column, at: Column, output: Column) -> Column:
    """Directory that a repository-root query confirmed."""
    return F.when(
        asked.isin("rev-parse --show-toplevel", "rev-parse --path-format=absolute --show-toplevel") & (output == at), at
    )


def locator_position(locator: Column) -> Column:
    found = F.regexp_extract(locator, r"^(?:decompressed-)?line:(\d+)(?:@\d+)?$", 1)
    return F.when(found != "", found.cast("long"))


def live_rows(
    records: DataFrame, occurrences: DataFrame, generations: DataFrame, sources: DataFrame
) -> DataFrame:
    """Records of current generations of live sources with their line position."""
    live = (
        generations.filter("status = 'current'")
        .join(
            sources.filter(F.col("status").isin(P.LIVE_SOURCE_STATUSES)).select("source_id"),
            "source_id", "left_semi",
        )
        .select("generation_id")
    )
    placed = (
        occurrences.join(live, "generation_id", "left_semi")
        .select("record_id", "generation_id", locator_position(F.col("locator")).alias("position"))
        .filter("position is not null")
    )
    return records.join(placed, "record_id")


def executions(live: DataFrame) -> DataFrame:
    """Successful native commands with what they did."""
    m = F.col("metadata")
    done = live.filter(
        (F.col("actor") == "tool") & (F.col("kind") == "recorded_tool_result")
        & (m["execution_source"] == "native_command_execution") & (m["exit_status"] == 0)
    )
    kept = ["record_id", "native_id", *_SESSION, "position", "event_time"]
    given = done.select(*kept, "cwd", "text", m["command"].alias("command"), m["command_argv"].alias("argv"))
    # Each step is computed once: later filters and joins would copy the definitions of these columns.
    read = settle(_with_arguments(_with_words(given)).select(*kept, "words", "_old", "_new", "_asked", "_at", "_output"))
    clean = pathops.clean_absolute
    output = F.when(F.col("_output").startswith("/"), clean(F.col("_output")))
    paths = {"_old": clean(F.col("_old")), "_new": clean(F.col("_new")), "_at": clean(F.col("_at")), "_output": output}
    return read.withColumns(paths).select(
        *kept, "words", _move_paths(F.col("_old"), F.col("_new")).alias("move"),
        _root_path(F.col("_asked"), F.col("_at"), F.col("_output")).alias("root"),
    )


def move_evidence(live: DataFrame) -> DataFrame:
    """One row per recorded move with what the records themselves say for and against it.

    Executions are worked out once and written, for four of the steps below read them;
    so is the result, which one or several calls of `reconcile_moves` judge.
    """
    runs = session.stage(executions(live), "runs")
    ahead = ordering.next_row(
        runs.withColumn("_seg", ordering.position_segment(F.col("position"))),
        _SESSION, "_seg", "position",
        F.struct("root", "position"), "following",
    )
    # A record copied into several generations is judged at its first place only.
    moves = (
        ahead.filter("move is not null")
        .groupBy("record_id")
        .agg(F.min_by(F.struct(*[c for c in ahead.columns if c not in ("record_id", "_seg")]),
                      F.struct("session_id", "generation_id", "position")).alias("_m"))
        .select("record_id", "_m.*")
        .select("*", F.col("move.old").alias("from_path"), F.col("move.new").alias("to_path"))
        .drop("move", "words")
    )
    # Settled, or the filter and the grouping would each clean the path anew.
    anchors = (
        settle(live.select("record_id", *_SESSION, "position", pathops.clean_absolute(F.col("cwd")).alias("_cwd")))
        .filter("_cwd is not null")
        .groupBy(*[F.col(c).alias("a_" + c) for c in _SESSION], F.col("_cwd").alias("a_path"))
        .agg(F.min(F.struct("position", "record_id")).alias("anchor"))
    )
    roots = (
        runs.filter("root is not null")
        .groupBy(*[F.col(c).alias("r_" + c) for c in _SESSION], F.col("root").alias("r_path"))
        .agg(F.min("position").alias("first_root"), F.max("position").alias("last_root"))
    )
    endpoints = (
        moves.select("record_id", F.explode(F.array("from_path", "to_path")).alias("p_path"))
        .groupBy("p_path")
        .agg(F.min("record_id").alias("_lo"), F.max("record_id").alias("_hi"))
        .select("p_path", (F.col("_lo") == F.col("_hi")).alias("sole"))
    )
    copies = (
        runs.filter(F.get("words", F.lit(0)).isin(P.COPY_COMMANDS))
        .select(*[F.col(c).alias("c_" + c) for c in _SESSION], F.explode_outer(F.slice("words", F.lit(2), F.lit(8))).alias("_arg"))
        .select("c_session_id", "c_generation_id", pathops.clean_absolute(F.col("_arg")).alias("c_path"))
        .filter("c_path is not null")
        .distinct()
    )
    same = lambda p: (F.col("session_id") == F.col(p + "_session_id")) & (
        F.col("generation_id") == F.col(p + "_generation_id")
    )
    copy_pairs = lambda name: copies.select(
        F.col("c_session_id").alias(name + "_session_id"),
        F.col("c_generation_id").alias(name + "_generation_id"),
        F.col("c_path").alias(name + "_path"),
    )
    # Joins by the same keys follow each other, so that moves are dealt anew only when the keys change.
    joined = (
        moves.join(anchors, same("a") & (F.col("from_path") == F.col("a_path")), "left")
        .join(copy_pairs("x"), same("x") & (F.col("from_path") == F.col("x_path")), "left")
        .join(roots, same("r") & (F.col("to_path") == F.col("r_path")), "left")
        .join(copy_pairs("y"), same("y") & (F.col("to_path") == F.col("y_path")), "left")
        .join(endpoints.select(F.col("p_path").alias("_p1"), F.col("sole").alias("_s1")), F.col("from_path") == F.col("_p1"), "left")
        .join(endpoints.select(F.col("p_path").alias("_p2"), F.col("sole").alias("_s2")), F.col("to_path") == F.col("_p2"), "left")
    )
    return session.stage(joined, "moves")


def reconcile_moves(
    live: DataFrame, worktrees: DataFrame, observations: DataFrame, projects: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """One row per recorded move with its verdict.

    `failure` is NULL for a supported move, which then names project, worktree
    and the evidence records.  `evidence` is `move_evidence` of the same records,
    for callers that judge them more than once.
    """
    moves = move_evidence(live) if evidence is None else evidence
    targets = _destinations(worktrees, projects)
    nested = _nested_worktrees(moves, worktrees)
    conflicts = _conflicting_observations(observations)
    joined = (
        moves.join(targets, F.col("to_path") == F.col("d_path"), "left")
        .join(nested, F.col("record_id") == F.col("n_record_id"), "left")
        .join(conflicts, F.col("from_path") == F.col("o_path"), "left")
    )
    following = F.col("following")
    failure = (
        F.when(~F.coalesce(F.col("anchor.position") < F.col("position"), F.lit(False)), "missing_prior_source_context")
        .when(~(F.coalesce("_s1", F.lit(False)) & F.coalesce("_s2", F.lit(False))), "ambiguous_move_endpoints")
        .when(~F.coalesce(F.col("last_root") > F.col("position"), F.lit(False)), "missing_later_git_root_evidence")
        .when(~F.coalesce(following["root"] == F.col("to_path"), F.lit(False)), "intervening_execution_requires_review")
        .when(F.col("first_root") < F.col("position"), "destination_existed_before_move")
        .when(F.col("x_path").isNotNull() | F.col("y_path").isNotNull(), "copy_operation_conflicts_with_move")
        .when(~F.coalesce(F.col("d_n") == 1, F.lit(False)), "destination_not_uniquely_registered")
        .when(F.col("n_record_id").isNotNull(), "separate_or_nested_worktree")
        .when(
            F.col("o_path").isNotNull()
            & ~(
                F.col("o_sole")
                & F.col("o_identity").eqNullSafe(F.col("d_target.identity"))
                & F.col("o_common").eqNullSafe(F.col("d_target.common_identity"))
            ),
            "historical_git_identity_conflict",
        )
    )
    judged = joined.withColumn("failure", failure)
    ok = F.col("failure").isNull()
    return judged.select(
        "record_id", "native_id", *_SESSION, "position", "event_time", "from_path", "to_path", "failure",
        F.when(ok, F.col("d_target.project_id")).alias("project_id"),
        F.when(ok, F.col("d_target.worktree_id")).alias("worktree_id"),
        F.when(ok, F.col("anchor.record_id")).alias("anchor_record_id"),
        F.when(ok, following["position"]).alias("root_position"),
    )


def _destinations(worktrees: DataFrame, projects: DataFrame) -> DataFrame:
    known = projects.select(F.col("project_id").alias("_pid"), "common_identity")
    return (
        worktrees.filter("active")
        .join(known, F.col("project_id") == F.col("_pid"), "left")
        .groupBy(F.col("path").alias("d_path"))
        .agg(
            F.count(F.lit(1)).alias("d_n"),
            F.min(F.struct("worktree_id", "project_id", "identity", "common_identity")).alias("d_target"),
        )
    )


def _nested_worktrees(moves: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Moves whose old path is, or whose paths enclose, another registered worktree."""
    enclosing = worktrees.select(
        F.col("path").alias("_tree"), F.explode_outer(pathops.ancestors(F.col("path"))).alias("_up")
    ).filter("_up is not null")
    ups = enclosing.groupBy("_up").agg(F.max(F.col("_tree") != F.col("_up")).alias("_below"))
    # One pass over worktrees and one over moves: an old path may be the worktree itself, a new one only encloses it.
    end = lambda path, old: F.struct(F.col(path).alias("path"), F.lit(old).alias("old"))
    ends = moves.select("record_id", F.inline(F.array(end("from_path", True), end("to_path", False))))
    hit = ends.join(ups, F.col("path") == F.col("_up")).filter("old or _below")
    return hit.select(F.col("record_id").alias("n_record_id")).distinct()


def _conflicting_observations(observations: DataFrame) -> DataFrame:
    d = F.col("data")
    pair = F.struct(d["worktree_identity"].alias("w"), d["common_identity"].alias("c"))
    return (
        observations.filter(d["available"])
        .groupBy(d["path"].alias("o_path"))
        .agg(F.min(pair).alias("_lo"), F.max(pair).alias("_hi"))
        .select(
            "o_path", F.col("_lo").eqNullSafe(F.col("_hi")).alias("o_sole"),
            F.col("_lo.w").alias("o_identity"), F.col("_lo.c").alias("o_common"),
        )
    )


def move_associations(live: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records of the old directory in the session and generation of a supported move."""
    supported = verdicts.filter("failure is null").select(
        F.col("session_id").alias("m_session"), F.col("generation_id").alias("m_generation"),
        "from_path", "project_id", "worktree_id",
    )
    rows = live.select(
        "record_id", *_SESSION, pathops.clean_absolute(F.col("cwd")).alias("_cwd")
    ).filter("_cwd is not null")
    return (
        rows.join(
            supported,
            (F.col("session_id") == F.col("m_session"))
            & (F.col("generation_id") == F.col("m_generation"))
            & (F.col("_cwd") == F.col("from_path")),
        )
        .groupBy("record_id")
        .agg(F.min(F.struct("project_id", "worktree_id")).alias("_t"))
        .select("record_id", "_t.*", F.lit(P.MOVE_REASON).alias("association_reason"))
    )


def identity_intervals(observations: DataFrame, worktrees: DataFrame, projects: DataFrame) -> DataFrame:
    """Per worktree: a former path, and the span until it was first seen at the present one."""
    d = F.col("data")
    trees = worktrees.filter("active").join(
        projects.select(F.col("project_id").alias("_pid"), "common_identity"),
        F.col("project_id") == F.col("_pid"), "left",
    ).select(
        F.col("worktree_id").alias("w_id"), F.col("project_id").alias("w_project"),
        F.col("path").alias("to_path"), F.col("identity").alias("w_identity"),
        F.col("common_identity").alias("w_common"),
    )
    seen = observations.filter(d["available"]).join(trees, F.col("worktree_id") == F.col("w_id"))
    former = (
        seen.filter(
            (d["path"] != F.col("to_path"))
            & d["worktree_identity"].eqNullSafe(F.col("w_identity"))
            & d["common_identity"].eqNullSafe(F.col("w_common"))
        )
        .groupBy("w_id", "w_project", "to_path", "w_identity", "w_common", pathops.clean_absolute(d["path"]).alias("from_path"))
        .agg(F.min("observed_at").alias("since"))
        .filter("from_path is not null")
    )
    # First arrival at or after `since`: carry arrivals backwards in time per worktree.
    micros = lambda c: F.unix_micros(F.col(c))
    starts = former.select("*", F.lit(None).cast("timestamp").alias("until"),
                           (-2 * micros("since") + 1).alias("_at"))
    arrivals = seen.filter(d["path"] == F.col("to_path")).select(
        "w_id", F.col("observed_at").alias("until"), (-2 * micros("observed_at")).alias("_at")
    )
    timeline = starts.unionByName(arrivals, allowMissingColumns=True).withColumn(
        "_seg", ordering.position_segment(F.col("_at"), 2 * 86_400_000_000)
    )
    spans = ordering.carry_forward(timeline, ["w_id"], "_seg", "_at", ["until"]).filter(
        "since is not null and until is not null"
    )
    conflicts = _conflicting_observations(observations)
    clean = spans.join(conflicts, F.col("from_path") == F.col("o_path"), "left")
    conflict = F.col("o_path").isNotNull() & ~(
        F.col("o_sole") & F.col("o_identity").eqNullSafe(F.col("w_identity"))
        & F.col("o_common").eqNullSafe(F.col("w_common"))
    )
    return clean.select(
        F.col("w_project").alias("project_id"), F.col("w_id").alias("worktree_id"),
        "from_path", "to_path", "since", "until",
        F.when(conflict, "historical_git_identity_conflict").alias("failure"),
    )


def associate_by_interval(live: DataFrame, intervals: DataFrame) -> DataFrame:
    """Unattributed records whose directory and time fall in an identity interval."""
    rows = live.filter(
        (F.col("time_status") == "known")
        & (F.col("project_id").isNull() | (F.col("association_reason") == P.INTERVAL_REASON))
    ).select("record_id", "event_time", pathops.clean_absolute(F.col("cwd")).alias("_cwd"))
    spans = intervals.filter("failure is null").select(
        F.col("project_id").alias("i_project"), F.col("worktree_id").alias("i_worktree"),
        "from_path", "since", "until",
    )
    return (
        rows.join(
            spans,
            (F.col("_cwd") == F.col("from_path"))
            & F.col("event_time").between(F.col("since"), F.col("until")),
        )
        .groupBy("record_id")
        .agg(F.min(F.struct("since", "i_project", "i_worktree")).alias("_t"))
        .select(
            "record_id", F.col("_t.i_project").alias("project_id"),
            F.col("_t.i_worktree").alias("worktree_id"),
            F.lit(P.INTERVAL_REASON).alias("association_reason"),
        )
    )


def revoke_unsupported(records: DataFrame, supported: DataFrame) -> DataFrame:
    """Derived attributions without present support are withdrawn."""
    ids = supported.select(F.col("record_id").alias("_sid")).distinct()
    joined = records.join(ids, records.record_id == F.col("_sid"), "left")
    stale = F.col("association_reason").isin(P.MOVE_REASON, P.INTERVAL_REASON) & F.col("_sid").isNull()
    null = F.lit(None).cast("string")
    return joined.withColumns(
        {
            "project_id": F.when(stale, null).otherwise(F.col("project_id")),
            "worktree_id": F.when(stale, null).otherwise(F.col("worktree_id")),
            "association_reason": F.when(stale, "move_evidence_unresolved").otherwise(F.col("association_reason")),
        }
    ).drop("_sid")


def apply_associations(records: DataFrame, derived: DataFrame) -> DataFrame:
    """Give unattributed, not explicitly mapped records their derived attribution."""
    d = derived.select(
        F.col("record_id").alias("_rid"), F.col("project_id").alias("_p"),
        F.col("worktree_id").alias("_w"), F.col("association_reason").alias("_why"),
    )
    joined = records.join(d, records.record_id == F.col("_rid"), "left")
    take = (
        F.col("_rid").isNotNull() & F.col("project_id").isNull()
        & (F.coalesce("association_reason", F.lit("")) != P.EXPLICIT_REASON)
    )
    return joined.withColumns(
        {
            "project_id": F.when(take, F.col("_p")).otherwise(F.col("project_id")),
            "worktree_id": F.when(take, F.col("_w")).otherwise(F.col("worktree_id")),
            "association_reason": F.when(take, F.col("_why")).otherwise(F.col("association_reason")),
        }
    ).drop("_rid", "_p", "_w", "_why")
