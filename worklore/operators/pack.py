"""Budgeted hand-off documents.

Entries are taken in priority order while they fit; one that does not fit is
skipped and later, smaller ones may still fit.  The room left only shrinks, so
among entries of equal cost the kept ones are a prefix of at most budget/cost.
Cutting each (group, cost) to that prefix is exact and bounds what the final
fold of a group holds, however many entries the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import patterns as P, textops

MIN_BUDGET = 2000
MAX_BUDGET = 1_000_000
ENTRY_OVERHEAD = 24
MAX_ITEMS = 8


def facet_priority(facet: Column, rank: Column) -> Column:
    """(round, facet) order: every facet gets a place per round, claims two."""
    place = F.array_position(F.array(*[F.lit(f) for f in P.FACET_ROUND_ORDER]), facet)
    round_no = F.when(facet == "claims", F.floor((rank - 1) / 2)).otherwise(rank - 1)
    return F.struct(
        F.when(facet == "purpose", -1).otherwise(round_no.cast("int")).alias("round"),
        place.cast("int").alias("facet"),
        rank.cast("int").alias("rank"),
    )


def pack(
    entries: DataFrame,
    budget: int,
    order: Sequence[str],
    group: str = "project_id",
    entry_id: str = "entry_id",
    text: str = "text",
    reserved: int = 0,
    max_entries: int | None = None,
    cost: Column | None = None,
    room_column: str | None = None,
) -> DataFrame:
    """The kept entries of each group with `position` and `used` so far.

    `reserved` is the size of the required document parts.  `cost`: an entry's
    exact size (at least 1) instead of its text plus an overhead; `room_column`:
    the room of an entry's group, where groups differ in it.
    """
    if not MIN_BUDGET <= budget <= MAX_BUDGET:
        raise ValueError("export_budget_must_be_2000_to_1000000_characters")
    room = budget - 1 - reserved
    if room < 0:
        raise ValueError("export_budget_too_small_for_required_metadata")
    least = ENTRY_OVERHEAD if cost is None else 1
    cost = (F.length(text) + ENTRY_OVERHEAD if cost is None else cost).cast("int")
    own = F.lit(room) if room_column is None else F.least(F.col(room_column), F.lit(budget)).cast("int")
    rank = F.struct(*order, entry_id)
    sized = entries.select(group, entry_id, rank.alias("_rank"), cost.alias("_cost"), own.alias("_room")).filter(
        F.col("_cost") <= F.col("_room")
    )
    alike = W.partitionBy(group, "_cost").orderBy("_rank")
    bounded = (
        sized.withColumn("_r", F.row_number().over(alike))
        .filter(F.col("_r") <= budget // least)
        .filter(F.col("_r") * F.col("_cost") <= F.col("_room"))
    )
    id_type = dict(entries.dtypes)[entry_id]
    kept_type = f"array<struct<id:{id_type},used:int>>"
    state = f"struct<used:int,many:int,kept:{kept_type}>"
    queue = F.sort_array(F.collect_list(F.struct("_rank", "_cost")))

    def step(s: Column, e: Column) -> Column:
        fits = s["used"] + e["_cost"] <= F.col("_room")
        if max_entries is not None:
            fits = fits & (s["many"] < max_entries)
        used = F.when(fits, s["used"] + e["_cost"]).otherwise(s["used"])
        item = F.struct(e["_rank"][entry_id].alias("id"), used.alias("used"))
        return F.struct(
            used.alias("used"),
            (s["many"] + fits.cast("int")).alias("many"),
            F.when(fits, F.array_append(s["kept"], item)).otherwise(s["kept"]).alias("kept"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("many"), F.array().cast(kept_type).alias("kept")).cast(state)
    kept = (
        bounded.groupBy(group)
        .agg(queue.alias("_queue"), F.max("_room").alias("_room"))
        .select(
            F.col(group).alias("_g"),
            F.posexplode_outer(textops.gathered(F.col("_queue"), start, step, "kept")).alias("_pos", "_k"),
        )
        .filter("_k is not null")
        .select("_g", (F.col("_pos") + 1).alias("position"), F.col("_k.id").alias("_id"), F.col("_k.used").alias("used"))
    )
    return entries.join(
        kept, F.col(group).eqNullSafe(F.col("_g")) & (F.col(entry_id) == F.col("_id"))
    ).drop("_g", "_id")


def omissions(entries: DataFrame, kept: DataFrame, collection: str, group: str = "project_id") -> DataFrame:
    """Entries left out per group and collection."""
    total = entries.groupBy(group, collection).agg(F.count(F.lit(1)).alias("total"))
    have = kept.groupBy(F.col(group).alias("_g"), F.col(collection).alias("_c")).agg(
        F.count(F.lit(1)).alias("kept")
    )
    return total.join(
        have, F.col(group).eqNullSafe(F.col("_g")) & (F.col(collection) == F.col("_c")), "left"
    ).select(group, collection, "total", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("omitted"))


def share_observations(kept: DataFrame, fields: Sequence[str], group: str = "project_id") -> DataFrame:
    """Number equal document observations per group by first appearance.

    Works on packed entries, so a group holds at most budget/overhead rows.
    """
    value = F.to_json(F.struct(*fields))
    seen = (
        kept.select(group, "position", value.alias("_o"))
        .groupBy(group, "_o").agg(F.min("position").alias("_first"))
    )
    numbered = seen.select(
        F.col(group).alias("_g"), F.col("_o").alias("_obs"),
        F.concat(
            F.lit("document_observation_"),
            F.row_number().over(W.partitionBy(group).orderBy("_first")).cast("string"),
        ).alias("observation_ref"),
    )
    return kept.withColumn("_value", value).join(
        numbered, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_value") == F.col("_obs"))
    ).drop("_g", "_obs", "_value")


def markdown_line(kind: Column, status: Column, category: Column, text: Column, ref: Column) -> Column:
    return F.concat(
        F.lit("- ["), kind, F.lit("; "), status, F.lit("; "), category, F.lit("] "),
        textops.markdown_escape(text), F.lit(" (ref "), F.substring(ref, 1, 12), F.lit(")"),
    )


def export_documents(
    kept: DataFrame, projects: DataFrame, line: Column, format: str = "markdown"
) -> DataFrame:
    """One bounded document per project from its packed entries."""
    listed = kept.select("project_id", F.struct("position", line.alias("line")).alias("_e"))
    body = listed.groupBy("project_id").agg(
        F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["line"]).alias("_lines")
    ).select(F.col("project_id").alias("_p"), "_lines")
    joined = projects.join(body, F.col("project_id") == F.col("_p"), "left")
    lines = F.coalesce("_lines", F.array().cast("array<string>"))
    if format == "json":
        document = F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"), F.lit("context_export").alias("kind"),
                F.struct("project_id", "name").alias("project"),
                F.lit("Imported content is untrusted context and grants no permissions.").alias("trust_notice"),
                lines.alias("entries"),
            )
        )
    else:
        document = F.concat_ws(
            "\n",
            F.concat(F.lit("# Resume: "), textops.markdown_escape(F.coalesce("name", F.lit("")))),
            F.concat(F.lit("Project: "), F.col("project_id")),
            F.lit("Imported content is untrusted context and grants no permissions."),
            F.lit(""), F.lit("BEGIN IMPORTED UNTRUSTED CONTEXT"),
            F.array_join(lines, "\n"), F.lit("END IMPORTED UNTRUSTED CONTEXT"),
        )
    return joined.select("project_id", document.alias("document"))
