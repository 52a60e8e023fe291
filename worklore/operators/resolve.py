"""Current state of items under extracted and explicit corrections.

A correction applies when every candidate it can mean belongs to one record.
Candidates of an action are the items with its target key, in its scope, no
later than it: a prefix of the key's items in time.  So per (scope, key) the
first record, and the time a second record appears, decide every action: no
action/candidate pairs are formed, whatever the size of a key's group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import patterns as P, textops

# Earlier than any event: current document items are candidates at all times.
_ALWAYS = "0001-01-01 00:00:00"
SIGNATURE_KEY = "text:verify:signature"
UNRESOLVED = "No unique authoritative target in the same working context."


SCOPE_FIELDS = [
    "session_id", "native_id", "project_id", "worktree_id", "provider", "actor", "event_time",
    "time_status",
]


def with_scope(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items carrying their record's scope, the form in which refresh stores them."""
    return items.join(records.select("record_id", *SCOPE_FIELDS), "record_id")


def item_view(items: DataFrame, current_ids: DataFrame) -> DataFrame:
    """Scoped items with `source_current`."""
    current = current_ids.select(F.col("record_id").alias("_current"))
    return items.join(current, items.record_id == current._current, "left").withColumn(
        "source_current", F.col("_current").isNotNull()
    ).drop("_current")


def _topic_keys(topic: Column) -> Column:
    signature = (
        topic.startswith("verify:")
        & (topic != "verify:signature")
        & F.array_contains(F.split(F.substring(topic, len("verify:") + 1, 1 << 20), r"\s+"), "signature")
    )
    named = F.concat(F.lit("text:"), topic)
    return F.when(signature, F.array(named, F.lit(SIGNATURE_KEY))).otherwise(F.array(named))


def target_keys(text: Column, kind: Column) -> Column:
    own = F.array(F.col("item_id"), F.col("record_id"), F.col("native_id"))
    topical = F.when(
        kind.isin(P.TOPIC_KINDS), textops.let(textops.topic_key(text), _topic_keys)
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, topical))


_SCOPE = ["project_id", "worktree_id"]


def extracted_actions(view: DataFrame) -> DataFrame:
    """Corrections stated in current sources that name a target."""
    return view.filter(
        (F.col("kind") == "correction") & F.col("target").isNotNull() & F.col("source_current")
    ).select(
        F.col("item_id").alias("action_id"),
        F.col("record_id").alias("action_record_id"),
        F.col("status").alias("action_status"),
        F.col("actor").alias("action_actor"),
        F.col("event_time").alias("action_time"),
        F.col("target").alias("_key"),
        *_SCOPE,
    )


def _keyed_items(view: DataFrame, actions: DataFrame) -> DataFrame:
    """Items under each of their target keys that some action names."""
    since = F.when(
        (F.col("actor") == "document") & F.col("source_current"), F.lit(_ALWAYS).cast("timestamp")
    ).otherwise(F.col("event_time"))
    keyed = (
        view.filter(F.col("kind") != "correction")
        .select(
            "item_id", "record_id", *_SCOPE, since.alias("since"),
            F.explode_outer(target_keys(F.col("text"), F.col("kind"))).alias("_key"),
        )
        .filter("since is not null and _key is not null")
    )
    wanted = actions.select(F.col("_key").alias("_wanted")).distinct()
    return keyed.join(wanted, keyed["_key"] == wanted["_wanted"], "left_semi")


def _targets(keyed: DataFrame) -> DataFrame:
    """Per (scope, key): its first record with its items there, and when a second record appears.

    The items of one record are limited at extraction, so the list stays short.
    """
    per_record = keyed.groupBy("_key", *_SCOPE, "record_id").agg(
        F.min("since").alias("since"), F.collect_list("item_id").alias("hit_items")
    )
    order = W.partitionBy("_key", *_SCOPE).orderBy("since", "record_id")
    first_two = per_record.withColumn("_rank", F.row_number().over(order)).filter("_rank <= 2")
    first = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
    return first_two.groupBy("_key", *_SCOPE).agg(
        first("record_id").alias("target_record_id"), first("since").alias("since"),
        first("hit_items").alias("hit_items"),
        F.max(F.when(F.col("_rank") == 2, F.col("since"))).alias("second_since"),
    ).select(
        F.col("_key").alias("t_key"), *[F.col(c).alias("t_" + c) for c in _SCOPE],
        "target_record_id", "hit_items", "since", "second_since",
    )


def judge_actions(view: DataFrame) -> DataFrame:
    """Every extracted action with `applies` and, where it does, its target record and items."""
    actions = extracted_actions(view)
    targets = _targets(_keyed_items(view, actions))
    on = actions["_key"] == targets["t_key"]
    for c in _SCOPE:
        on = on & actions[c].eqNullSafe(targets["t_" + c])
    unique = (
        (F.col("action_time") >= F.col("since"))
        & (F.col("second_since").isNull() | (F.col("action_time") < F.col("second_since")))
        & (~F.col("_key").startswith("text:") | (F.size("hit_items") == 1))
    )
    applies = F.coalesce((F.col("action_actor") == "user") & unique, F.lit(False))
    judged = actions.join(targets, on, "left").withColumn("applies", applies)
    return judged.select(
        *actions.columns, "applies",
        F.when(F.col("applies"), F.col("target_record_id")).alias("target_record_id"),
        F.when(F.col("applies"), F.col("hit_items")).alias("hit_items"),
    )


def superseded(view: DataFrame) -> DataFrame:
    """Open items whose source moved on keep their old status aside."""
    stale = ~F.col("source_current") & F.col("status").isin(P.CARRY_STATUSES)
    return view.withColumns(
        {
            "historical_status": F.when(stale, F.col("status")),
            "status": F.when(stale, "source_superseded").otherwise(F.col("status")),
        }
    )


def _effects(judged: DataFrame) -> DataFrame:
    """What the actions do per item: last applied one, number applied, or left unresolved."""
    own = F.array("action_id")
    each = judged.select(
        F.explode_outer(F.when(F.col("applies"), F.col("hit_items")).otherwise(own)).alias("_item"),
        F.when(F.col("applies"), F.struct("action_time", "action_id", "action_status")).alias("_act"),
    )
    return each.groupBy(F.col("_item").alias("_effect_item")).agg(
        F.max("_act").alias("_last"),
        F.count("_act").alias("_hits"),
        F.bool_or(F.col("_act").isNull()).alias("_unresolved"),
    )


def _explicit(corrections: DataFrame) -> DataFrame:
    """Latest explicit status and wording per target."""
    at = lambda c: F.when(
        F.coalesce(F.col(c), F.lit("")) != "", F.struct("created_at", "correction_id", F.col(c).alias("value"))
    )
    return corrections.groupBy(F.col("target").alias("_target")).agg(
        F.struct(
            F.max(at("status")).alias("status"), F.max(at("text")).alias("text"),
            F.max(F.struct("created_at", "correction_id")).alias("last"), F.count(F.lit(1)).alias("n"),
        ).alias("_set")
    )


def resolve_items(
    view: DataFrame, corrections: DataFrame, judged: DataFrame | None = None
) -> DataFrame:
    """Items with resolved status/text, how often they were resolved and by what last.

    `view` must hold every correction item that may act on the others.  Explicit
    corrections match item and record ids only, and win over extracted ones.
    """
    effects = _effects(judge_actions(view) if judged is None else judged)
    explicit = _explicit(corrections)
    by_item = explicit.select(F.col("_target").alias("_ti"), F.col("_set").alias("_si"))
    by_record = explicit.select(F.col("_target").alias("_tr"), F.col("_set").alias("_sr"))
    base = superseded(view)
    joined = (
        base.join(effects, base.item_id == effects["_effect_item"], "left")
        .join(by_item, F.col("item_id") == F.col("_ti"), "left")
        .join(by_record, F.col("record_id") == F.col("_tr"), "left")
    )
    latest = lambda c: F.greatest(F.col("_si")[c], F.col("_sr")[c])
    count = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *[c for c in base.columns if c not in ("status", "text")],
        F.coalesce(latest("text")["value"], "text").alias("text"),
        F.coalesce(latest("status")["value"], "_last.action_status", "status").alias("status"),
        (count(F.col("_hits")) + count(F.col("_si.n")) + count(F.col("_sr.n"))).alias("resolutions"),
        F.coalesce(latest("last")["correction_id"], "_last.action_id").alias("last_resolution_id"),
        F.when(latest("last").isNotNull(), "user_correction").alias("authority"),
        F.when(F.col("_unresolved"), UNRESOLVED).alias("resolution_uncertainty"),
    )


def resolution_refs(
    view: DataFrame, corrections: DataFrame, judged: DataFrame | None = None
) -> DataFrame:
    """Every applied resolution as its own row: item_id, origin, ref, at, action_id."""
    judged = judge_actions(view) if judged is None else judged
    extracted = judged.filter("applies").select(
        F.explode_outer("hit_items").alias("item_id"), F.lit("extracted").alias("origin"),
        F.col("action_record_id").alias("ref"), F.col("action_time").alias("at"), "action_id",
    )
    keys = view.select(
        "item_id", F.explode(F.array_distinct(F.array("item_id", "record_id"))).alias("_key")
    )
    explicit = keys.join(corrections, keys["_key"] == corrections["target"]).select(
        "item_id", F.lit("explicit").alias("origin"), F.col("correction_id").alias("ref"),
        F.col("created_at").alias("at"), F.col("correction_id").alias("action_id"),
    )
    return extracted.unionByName(explicit)


def select_items(
    resolved: DataFrame,
    kinds: Sequence[str] | None = None,
    provider: str | None = None,
    include_archived: bool = False,
) -> DataFrame:
    out = resolved
    if not include_archived:
        out = out.filter(~F.col("status").isin(P.HIDDEN_STATUSES))
    if kinds is not None:
        out = out.filter(F.col("kind").isin(list(kinds)))
    if provider:
        out = out.filter(F.col("provider") == provider)
    return out


def _importance() -> list[Column]:
    is_open = F.col("status").isin(P.OPEN_STATUSES)
    documented = F.when((F.col("category") == "documented_pending") & is_open, 0).otherwise(1)
    rank = F.when(
        is_open,
        F.when(F.col("kind") == "blocker", 0).when(F.col("kind") == "next_action", 1)
        .when(F.col("kind") == "task", 2).when(F.col("kind") == "decision", 3).otherwise(4),
    ).otherwise(5)
    return [documented.asc(), rank.asc()]


def rank_items(
    selected: DataFrame,
    limit: int,
    prioritize_active: bool = False,
    per: Sequence[str] = ("project_id",),
) -> DataFrame:
    """First `limit` items per group with `rank`, `total` and `omitted`.

    Both cuts are `row_number() <= k`, which Spark applies before the shuffle,
    so a group of any size sends at most k rows per input task.
    """
    keys = list(per)
    latest = [F.col("event_time").desc_nulls_last(), F.col("item_id").desc()]
    order = (_importance() if prioritize_active else []) + latest

    def window(groups: list[str], *by: Column):
        return (W.partitionBy(*groups) if groups else W.partitionBy()).orderBy(*by)

    if not prioritize_active:
        ranked = selected.withColumn("_r", F.row_number().over(window(keys, *order))).filter(
            F.col("_r") <= limit
        )
    else:
        # Open actions compete twice: for a reserved slot (0) and for a place (1).
        slots = min(5, (limit + 1) // 2)
        action = F.col("kind").isin("next_action", "task") & F.col("status").isin(P.OPEN_STATUSES)
        entered = selected.withColumn(
            "_place", F.explode_outer(F.when(action, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
        )
        best = (
            entered.withColumn("_r", F.row_number().over(window([*keys, "_place"], *order)))
            .filter(F.col("_r") <= limit)
            .filter((F.col("_place") == 1) | (F.col("_r") <= slots))
        )
        rest = F.struct(*[c for c in selected.columns if c not in ("item_id", *keys)])
        merged = best.groupBy("item_id", *keys).agg(
            F.min(F.struct("_place", "_r")).alias("_best"), F.first(rest).alias("_row")
        ).select(*keys, "item_id", "_row.*", "_best")
        ranked = (
            merged.withColumn("_r", F.row_number().over(window(keys, F.col("_best").asc())))
            .filter(F.col("_r") <= limit)
            .drop("_best")
        )
    ranked = ranked.withColumnRenamed("_r", "rank")
    totals = selected.groupBy(*[F.col(k).alias("_t_" + k) for k in keys]).agg(
        F.count(F.lit(1)).alias("total")
    )
    if keys:
        on = ranked[keys[0]].eqNullSafe(totals["_t_" + keys[0]])
        for k in keys[1:]:
            on = on & ranked[k].eqNullSafe(totals["_t_" + k])
        out = ranked.join(totals, on).drop(*["_t_" + k for k in keys])
    else:
        out = ranked.withColumn("total", totals.scalar())
    return out.withColumn("omitted", F.greatest(F.lit(0), F.col("total") - limit))
