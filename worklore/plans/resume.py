"""Resume: the composed per-project state, for one project or all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import patterns as P
from ..operators import associate, evidence as ev, facets, pack, resolve
from ..session import stage
from . import context, views


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """One row over everything that is stored, whatever project is asked for: sources, gaps, status."""
    counts = tables["sources"].agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") != "ready").alias("sources_not_ready")
    )
    gaps = views.record_gaps(tables["records"]).select(F.struct("*").alias("_g"))
    runs = tables.get("refresh_runs")
    state = F.lit("not_refreshed") if runs is None else F.coalesce(
        views.coverage_status(runs).select("coverage_status").scalar(), F.lit("not_refreshed")
    )
    return counts.withColumn("_g", gaps.scalar()).select(
        "sources", "sources_not_ready", "_g.unassociated_records", "_g.unknown_event_times", state.alias("coverage_status")
    )


def identity_report(verdicts: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """What ties former locations to a project: associations, moves that were observed, doubts.

    `verdicts` as `moves.reconcile_moves` gives them, `intervals` as
    `moves.identity_intervals` does.  What was rejected belongs to no project.
    """
    moved = verdicts.select(
        "project_id", "worktree_id", "record_id", "from_path", "to_path",
        F.lit(None).cast("timestamp").alias("since"), F.col("event_time").alias("until"), F.col("failure").alias("code"),
    )
    held = moved.filter("code is null")
    parts = [
        held.withColumn("part", F.lit("association")), held.withColumn("part", F.lit("observed_operation")),
        moved.filter("code is not null").withColumn("part", F.lit("uncertainty")),
    ]
    if intervals is not None:
        spans = intervals.select(
            *[F.when(F.col("failure").isNull(), F.col(c)).alias(c) for c in ("project_id", "worktree_id")],
            F.lit(None).cast("string").alias("record_id"), "from_path", "to_path", "since", "until", F.col("failure").alias("code"),
        )
        parts.append(spans.withColumn("part", F.when(F.col("code").isNull(), "association").otherwise("uncertainty")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def notices(selected: DataFrame, worktrees: DataFrame, projects: DataFrame, covered: DataFrame) -> DataFrame:
    """Doubts about a project as a whole: worktrees gone, items left out, coverage incomplete."""
    gone = worktrees.filter("not active").groupBy("project_id").agg(F.count(F.lit(1)).alias("amount")).select(
        "project_id", F.lit("worktree_unavailable").alias("code"), "amount"
    )
    omitted = selected.groupBy("project_id").agg(F.max("omitted").alias("amount")).filter("amount > 0").select(
        "project_id", F.lit("items_omitted").alias("code"), F.col("amount").cast("long").alias("amount")
    )
    incomplete = projects.select("project_id").distinct().withColumn(
        "_status", covered.select("coverage_status").scalar()
    ).filter("_status <> 'passed'").select("project_id", F.lit("coverage_incomplete").alias("code"), F.lit(None).cast("long").alias("amount"))
    return gone.unionByName(omitted).unionByName(incomplete)


def _beside_all(projects: DataFrame, report: DataFrame) -> DataFrame:
    """Doubts without a project stand beside every project; there are as many as kinds of doubt."""
    codes = report.filter("part = 'uncertainty' and project_id is null").agg(
        F.array_sort(F.collect_set("code")).alias("codes")
    )
    return projects.select("project_id").distinct().select("project_id", F.explode(codes.scalar()).alias("code"))


def resume_all(tables: dict[str, DataFrame], limit: int = 50) -> dict[str, DataFrame]:
    """Relations of the resume, each keyed by project_id (`coverage` has one row for all).

    `tables`: projects, worktrees, observations, records (with event_type,
    revision, exit_status, relative_path, section), items (scoped), occurrences,
    generations, sources, corrections, associations, memory; optionally
    refresh_runs, and verdicts and intervals of recorded moves.

    What several relations read (the resolution, the selection, the window, document
    items, facets, the instruction) is written once under spark.checkpoint.dir.
    """
    records, items = tables["records"], tables["items"]
    current = ev.current_record_ids(tables["occurrences"], tables["generations"])
    located = ev.locations(tables["occurrences"], tables["generations"], tables["sources"])
    view = resolve.item_view(items, current)
    resolved = stage(resolve.resolve_items(view, tables["corrections"]), "resume-resolved")
    selected = stage(resolve.rank_items(resolve.select_items(resolved), limit, prioritize_active=True), "resume-selected")
    window = stage(context.recent_context(records), "resume-window")
    instruction = stage(context.latest_instruction(records, current), "resume-instruction")
    # An observation of another repository says nothing of the project's present state.
    observations = associate.blank_foreign_observations(tables["observations"], tables["projects"])

    place = records.filter(F.col("provider") == P.PROVIDER_DOCUMENT).select(
        "record_id", "relative_path", "section"
    )
    documents = stage(
        resolve.select_items(resolved, provider=P.PROVIDER_DOCUMENT).join(place, "record_id", "left"), "resume-documents"
    )
    shown = stage(facets.brief_facets(documents), "resume-facets")
    pending_evidence = ev.evidence(
        records.join(shown.filter("facet = 'pending'").select("record_id").distinct(), "record_id", "left_semi"),
        located,
    ).select("record_id", "evidence_status", "places_not_ready")
    pending = shown.filter("facet = 'pending'").join(pending_evidence, "record_id")
    conflicts = facets.project_conflicts(documents).select("project_id", "code").unionByName(
        facets.topic_conflicts(documents).select("project_id", "code")
    ).unionByName(context.procedure_changes(instruction).select("project_id", "code"))
    stops = context.stopping_point(window)
    report = None
    if "verdicts" in tables:
        report = stage(identity_report(tables["verdicts"], tables.get("intervals")), "resume-identity")
        conflicts = conflicts.unionByName(_beside_all(tables["projects"], report))
        observed = report.filter("part = 'observed_operation'").withColumnRenamed("until", "event_time")
        stops = context.moved_stopping_point(stops, observed)
    actions = context.next_actions(selected, tables["worktrees"])
    covered = coverage(tables)
    out = {
        "project": views.project_view(tables["projects"], tables["worktrees"], observations, records),
        "coverage": covered,
        "notices": notices(selected, tables["worktrees"], tables["projects"], covered),
        "sessions": views.recent_sessions(records),
        "items": selected,
        "unfinished": selected.filter(
            F.col("kind").isin(P.ACTION_KINDS) & F.col("status").isin(P.OPEN_STATUSES)
        ),
        "decisions": selected.filter(
            (F.col("kind") == "decision")
            & ~F.col("status").isin("superseded", "source_superseded", "cancelled", "rejected", "archived")
        ),
        "claims": selected.filter("kind = 'claim'"),
        "objective": views.objectives(resolved),
        "next_actions": context.combined_actions(
            pending, actions, tables["worktrees"], instruction, conflicts
        ),
        "latest_instruction": instruction,
        "stopping_point": stops,
        "agent_updates": context.agent_updates(window, instruction),
        "recent_results": context.recent_results(window),
        "facts": context.recorded_facts(window),
        "evidence": context.recorded_evidence(window),
        "uncertainties": context.uncertainties(
            window, selected, observations,
            ev.project_sources(records, tables["occurrences"], tables["generations"], tables["sources"]),
        ),
        "facets": shown,
        "facet_omissions": facets.facet_omissions(documents, shown),
        "conflicts": conflicts,
        "principles": views.principles(tables["memory"], accepted_only=True),
        "mappings": views.recent_mappings(tables["associations"]),
    }
    if report is not None:
        out["identity"] = report.filter("project_id is not null")
    return out


def resume(tables: dict[str, DataFrame], project_id: str, limit: int = 50, worktree_id: str | None = None) -> dict[str, DataFrame]:
    """One project: the filter reaches the scans of records and items."""
    scoped = dict(tables)
    for name in ("records", "items", "projects", "worktrees", "observations", "associations"):
        scoped[name] = tables[name].filter(F.col("project_id") == project_id)
        if worktree_id and "worktree_id" in tables[name].columns:
            scoped[name] = scoped[name].filter(F.col("worktree_id") == worktree_id)
    for name in {"verdicts", "intervals"} & set(tables):
        # Rejected moves have no project; they stay, for their doubts concern every project.
        mine = F.col("project_id").isNull() | (F.col("project_id") == project_id)
        if worktree_id:
            mine &= F.col("worktree_id").isNull() | (F.col("worktree_id") == worktree_id)
        scoped[name] = tables[name].filter(mine)
    out = resume_all(scoped, limit)
    out["coverage"] = coverage(tables)
    out["notices"] = notices(out["items"], scoped["worktrees"], scoped["projects"], out["coverage"])
    out["principles"] = views.principles(tables["memory"], project_id, accepted_only=True)
    out["user_memory"] = views.accepted_memory(tables["memory"], project_id)
    return out


def _first_items(items: DataFrame) -> DataFrame:
    """The first items of each project, at most as many as an export lists."""
    first = F.row_number().over(W.partitionBy("project_id").orderBy("rank"))
    return items.withColumn("_n", first).filter(F.col("_n") <= pack.MAX_ITEMS).drop("_n")


def export_entries(parts: dict[str, DataFrame]) -> DataFrame:
    """Hand-off entries of all collections in priority order: tier, then order."""
    null = F.lit(None).cast("string")

    def entry(df, collection, tier, place, text, ref="record_id"):
        return df.select(
            "project_id", F.lit(collection).alias("collection"), F.lit(tier).alias("tier"),
            place.alias("place"),
            F.coalesce(F.col("status"), F.lit("recorded")).alias("status") if "status" in df.columns else F.lit("recorded").alias("status"),
            F.col(text).alias("text"),
            (F.col(ref) if ref else null).alias("ref"),
        )

    first = F.struct(F.lit(0).alias("round"), F.lit(0).alias("facet"), F.lit(1).alias("rank"))
    nth = lambda column: F.struct(
        F.lit(0).alias("round"), F.lit(0).alias("facet"), F.col(column).cast("int").alias("rank")
    )
    shown = parts["facets"]
    pieces = [
        entry(shown.filter("facet = 'purpose'"), "context", 1, first, "text"),
        entry(parts["latest_instruction"], "context", 2, first, "text"),
        entry(parts["stopping_point"].withColumn("text", F.substring("text", 1, 700)), "context", 3, first, "text"),
        entry(parts["recent_results"], "context", 4, nth("rank"), "excerpt"),
        entry(
            shown.filter("facet <> 'purpose'"), "context", 6,
            pack.facet_priority(F.col("facet"), F.col("facet_rank")), "text",
        ),
        entry(parts["agent_updates"], "context", 7, nth("rank"), "text"),
        entry(
            _first_items(parts["items"].filter(~F.col("category").startswith("documented_") & (F.length("text") <= 1500))),
            "items", 8, nth("rank"), "text",
        ),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out.withColumn(
        "entry_id", F.sha2(F.concat_ws("|", "collection", "tier", F.to_json("place"), "ref", "text"), 256)
    )


def export(parts: dict[str, DataFrame], projects: DataFrame, budget: int = 24000, format: str = "markdown") -> DataFrame:
    """Bounded hand-off document per project.

    Lines are rendered first and packed by their exact length, the room being
    what the project's empty document leaves; a budget below that is an error.
    """
    line = pack.markdown_line(
        F.col("collection"), F.col("status"), F.col("tier").cast("string"), F.col("text"), F.coalesce("ref", F.lit(""))
    )
    entries = export_entries(parts).withColumn("line", line)
    named = projects.select("project_id", "name")
    size = F.length("line") + 1 if format != "json" else F.length(F.to_json(F.array("line"))) - 1
    none = entries.filter("false").withColumn("position", F.lit(0))
    empty = pack.export_documents(none, named, F.col("line"), format)
    small = F.raise_error(F.lit("export_budget_too_small_for_required_metadata")).cast("int")
    left = F.lit(budget) - F.length("document")
    rooms = empty.select(F.col("project_id").alias("_p"), F.when(left >= 0, left + 1).otherwise(small).alias("_left"))
    entries = entries.join(rooms, F.col("project_id") == F.col("_p")).drop("_p")
    kept = pack.pack(entries, budget, ["tier", "place"], text="line", cost=size, room_column="_left")
    return pack.export_documents(kept, named, F.col("line"), format)
