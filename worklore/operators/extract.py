"""Records -> statements (items).

Lines are classified row by row; only emitted statements are shuffled, by record,
to number them and to attach attribute lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashing, patterns as P, textops
from ..functions.plans import settle
from .prose import prose_lines

CANDIDATE = (
    "struct<kind:string,text:string,status:string,category:string,target:string,"
    "rationale:string,priority:string,dependencies:array<string>,method:string>"
)
_NAMES = sorted(P.ATTRIBUTE_NAMES, key=len, reverse=True)
ATTRIBUTE_LINE = P.ci(r"^(" + "|".join(_NAMES) + r")\s*:\s*(.+)$")
_ID = (
    r"(?:\[[A-Za-z0-9][A-Za-z0-9_.:-]*\]|<[A-Za-z0-9][A-Za-z0-9_.:-]*>|#[A-Za-z0-9][A-Za-z0-9_-]*|"
    r"(?=[A-Za-z0-9_-]*[0-9_-])[A-Za-z0-9][A-Za-z0-9_-]*)(?=$|[\s,.;:])"
)
TARGET_HEAD = P.cs(r"^(" + _ID + r"(?:\s*,\s*" + _ID + r")*)")

MARKER_LINE = P.ci(r"^(" + "|".join(sorted(P.MARKERS, key=len, reverse=True)) + r")\s*:\s*(.+)$")


def candidate(
    kind: Column | str,
    text: Column,
    status: Column | str,
    category: Column | str,
    target: Column | None = None,
    rationale: Column | None = None,
    priority: Column | None = None,
    dependencies: Column | None = None,
    method: str = "explicit-v1",
) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    null = F.lit(None).cast("string")
    return F.struct(
        lit(kind).alias("kind"),
        text.alias("text"),
        lit(status).alias("status"),
        lit(category).alias("category"),
        (null if target is None else target).alias("target"),
        (null if rationale is None else rationale).alias("rationale"),
        (null if priority is None else priority).alias("priority"),
        (F.array().cast("array<string>") if dependencies is None else dependencies).alias("dependencies"),
        F.lit(method).alias("method"),
    ).cast(CANDIDATE)


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    folded = {name.upper().replace("İ", "I"): value for name, value in table.items()}
    pairs = [F.lit(x) for pair in folded.items() for x in pair]
    return F.element_at(F.create_map(*pairs), textops.fold_marker(key))


def correction_targets(body: Column) -> Column:
    """Distinct explicit ids that lead a correction, in order."""
    head = F.regexp_extract(F.ltrim(body), TARGET_HEAD, 1)
    ids = F.regexp_extract_all(head, F.lit(P.cs("(" + _ID + ")")), F.lit(1))
    return F.array_distinct(
        F.transform(ids, lambda x: F.regexp_replace(x, r"^[\[<#]|[\]>]$", ""))
    )


def split_dependencies(value: Column) -> Column:
    parts = F.transform(F.split(value, ","), lambda x: F.btrim(textops.strip_ws(x), F.lit("[]")))
    return F.filter(parts, lambda x: x != "")


FOUND = "array<struct<name:string,value:string>>"


def inline_attributes(text: Column) -> Column:
    """The ` | NAME: value` attributes of a statement, in order."""
    tail = F.slice(F.split(text, r" \| "), F.lit(2), F.lit(1 << 20))
    return F.transform(
        F.filter(tail, lambda x: F.btrim(x).rlike(ATTRIBUTE_LINE)),
        lambda x: F.struct(
            _lookup(P.ATTRIBUTE_NAMES, F.regexp_extract(F.btrim(x), ATTRIBUTE_LINE, 1)).alias("name"),
            textops.strip_ws(F.regexp_extract(F.btrim(x), ATTRIBUTE_LINE, 2)).alias("value"),
        ),
    )


def without_attributes(text: Column) -> Column:
    parts = F.split(text, r" \| ")
    kept = F.filter(parts, lambda x, i: (i == 0) | ~F.btrim(x).rlike(ATTRIBUTE_LINE))
    return F.array_join(kept, " | ")


def _last_named(found: Column, name: str) -> Column:
    return F.get(F.reverse(F.filter(found, lambda x: x["name"] == name)), F.lit(0))["value"]


def _first_sentence(text: Column) -> Column:
    return F.element_at(F.split(text, P.cs(P.SENTENCE_BREAK), 2), 1)


def is_transition(first: Column) -> Column:
    """A user sentence that by itself closes a named subject."""
    stated = textops.matches(first, P.TRANSITION_VERB) | textops.matches(first, P.TRANSITION_STATE)
    return textops.matches(first, P.TURKISH_CANCEL) | (
        stated & ~textops.matches(first, P.TRANSITION_NEGATION)
    )


def transition_subject(first: Column) -> Column:
    return (
        F.when(textops.matches(first, P.TURKISH_CANCEL), F.regexp_extract(first, P.ci(P.TURKISH_CANCEL), 1))
        .when(textops.matches(first, P.TRANSITION_VERB), F.regexp_extract(first, P.ci(P.TRANSITION_VERB), 1))
        .otherwise(F.regexp_extract(first, P.ci(P.TRANSITION_STATE), 1))
    )


def transition_status(first: Column) -> Column:
    return (
        F.when(textops.matches(first, P.TURKISH_CANCEL), "cancelled")
        .when(textops.matches(first, P.TRANSITION_COMPLETED), "user_completed")
        .when(textops.matches(first, P.TRANSITION_SUPERSEDED), "superseded")
        .otherwise("cancelled")
    )


def prose_rung(text: Column, actor: Column) -> Column:
    """Name of the first rule of the prose ladder that fits, NULL when none does."""
    user = actor == "user"
    return (
        F.when((text == "") | ~actor.isin("user", "assistant") | textops.matches(text, P.EXAMPLE), F.lit(None))
        .when(user & textops.is_conversational(text), "conversation")
        .when(textops.matches(text, P.NEGATED_PENDING), "negated")
        .when(textops.matches(text, P.CONDITIONAL_START), "conditional")
        .when(user & is_transition(_first_sentence(text)), "transition")
        .when(textops.matches(text, P.DEFERRED), "deferred")
        .when(textops.matches(text, P.PENDING),
              F.when(textops.is_blocked(text), "blocker").otherwise("task"))
        .when(user & textops.matches(text, P.USER_IMPERATIVE), "next_action")
        .when((actor == "assistant") & textops.matches(text, P.ASSISTANT_SUCCESS), "claim")
    )


# rung -> kind, status, category for the user, category for the assistant
PROSE_RULES = {
    "conversation": ("conversation", "unresolved", "conversation_management", None),
    "negated": ("context", "reported", "user_report", "agent_claim"),
    "conditional": ("constraint", "recorded", "recorded_instruction", "agent_proposal"),
    "deferred": ("context", "deferred", "recorded_instruction", "agent_proposal"),
    "blocker": ("blocker", "blocked", "user_intent", "agent_claim"),
    "task": ("task", "active", "user_intent", "agent_claim"),
    "next_action": ("next_action", "active", "user_intent", None),
    "claim": ("claim", "unverified", None, "agent_claim"),
}


def _rule(rung: Column, field: int) -> Column:
    pairs = [F.lit(x) for name, rule in PROSE_RULES.items() if rule[field] for x in (name, rule[field])]
    return F.element_at(F.create_map(*pairs), rung)


def _suffixes(text: Column) -> Column:
    """The text, and what remains after each leading closing sentence."""
    sentences = F.split(text, P.cs(P.SENTENCE_BREAK))
    stops = F.array_append(F.transform(sentences, lambda s: ~is_transition(s)), F.lit(True))
    leading = (F.array_position(stops, F.lit(True)) - 1).cast("int")
    last = F.least(leading, F.size(sentences) - 1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.array_join(F.slice(sentences, k + 1, F.size(sentences)), " "),
    )


def classified_lines(spoken: DataFrame) -> DataFrame:
    """record_id, line_no, k, closing, attribute, value, cands - one row per text to classify."""
    lines = settle(prose_lines(spoken, keep=("actor",)))
    line, who = F.col("line"), F.col("actor")
    attribute = F.regexp_extract(line, ATTRIBUTE_LINE, 1)
    marked = lines.withColumns(
        {
            "attribute": _lookup(P.ATTRIBUTE_NAMES, F.nullif(attribute, F.lit(""))),
            "marker": _lookup(P.MARKERS, F.nullif(F.regexp_extract(line, MARKER_LINE, 1), F.lit(""))),
        }
    )
    routed = marked.withColumn(
        "route",
        F.when(F.col("attribute").isNotNull(), "attribute")
        .when(F.col("marker").isNotNull(), "marker")
        .when((who == "user") & ~textops.is_conversational(line) & textops.matches(line, P.REQUEST), "request")
        .otherwise("prose"),
    )
    is_prose = F.col("route") == "prose"
    unfolded = routed.select(
        "record_id", "actor", "line_no", "line", "attribute", "marker", "route",
        F.posexplode_outer(
            F.when(is_prose & (who == "user"), _suffixes(textops.prose(line)))
            .when(is_prose, F.array(textops.prose(line)))
            .otherwise(F.array(line))
        ).alias("k", "text"),
    )
    marker, text, rung = F.col("marker"), F.col("text"), F.col("rung")
    transition = marker.isin(P.TRANSITION_STATUSES)
    is_marker, is_request = F.col("route") == "marker", F.col("route") == "request"
    body = textops.strip_ws(F.regexp_extract(line, MARKER_LINE, 2))
    ruled = unfolded.withColumns(
        {
            "rung": F.when(is_prose, prose_rung(text, who)),
            "body": F.when(is_marker, body).when(is_request, line),
            "attributed": is_request | (is_marker & ~transition),
            "first": F.when(is_prose, _first_sentence(text)),
        }
    )
    fallback = (
        is_prose & rung.isNull() & (who == "assistant")
        & textops.matches(F.regexp_replace(line, P.INLINE_CODE, " "), P.MARKER_SUCCESS)
    )
    proposer = F.when(who == "assistant", "agent_proposal").otherwise("interpretation")
    attributed, closing = F.col("attributed"), rung == "transition"
    user = who == "user"
    filled = ruled.withColumns(
        {
            "kind": F.when(is_marker & ~transition, marker)
            .when(is_marker & ~user & (marker == "user_completed"), "claim")
            .when(is_marker | closing, "correction")
            .when(is_request, "next_action")
            .when(fallback, "claim")
            .otherwise(_rule(rung, 0)),
            "status": F.when(is_marker & transition, F.when(user, marker).when(marker == "user_completed", "unverified").otherwise("proposed"))
            .when(is_marker & (marker == "principle"), "proposed")
            .when(is_marker & (marker == "blocker") & who.isin("user", "assistant"), "blocked")
            .when(is_marker, F.when(user, "active").otherwise("proposed"))
            .when(is_request, "active")
            .when(fallback, "unverified")
            .when(closing, transition_status(F.col("first")))
            .otherwise(_rule(rung, 1)),
            "category": F.when(is_marker & transition & user | closing, "user_correction")
            .when(is_marker & (marker == "principle"), "interpretation")
            .when(is_marker & user | is_request, "user_intent")
            .when(is_marker & (who == "assistant") & marker.isin("blocker", "user_completed"), "agent_claim")
            .when(is_marker, proposer)
            .when(fallback, "agent_claim")
            .otherwise(F.when(user, _rule(rung, 2)).otherwise(_rule(rung, 3))),
            "said": F.when(attributed, without_attributes(F.col("body")))
            .when(is_marker, F.col("body"))
            .when(closing, F.col("first"))
            .when(fallback, line)
            .otherwise(text),
            "found": F.when(attributed, inline_attributes(F.col("body"))),
            "targets": F.when(is_marker & transition & user, correction_targets(F.col("body")))
            .when(closing, F.array(F.concat(F.lit("text:"), textops.topic_key(transition_subject(F.col("first")))))),
            "method": F.when(is_prose & ~fallback, "prose-v1").otherwise("explicit-v1"),
        }
    )
    found, targets = F.col("found"), F.col("targets")
    nothing = F.array(F.lit(None).cast("string"))
    completed = filled.withColumns(
        {
            "rationale": _last_named(found, "rationale"),
            "priority": F.coalesce(
                _last_named(found, "priority"),
                F.when(attributed & textops.matches(F.col("said"), P.CRITICAL_PREFIX), "critical"),
            ),
            "dependencies": F.coalesce(
                split_dependencies(_last_named(found, "dependencies")), F.array().cast("array<string>")
            ),
            "targets": F.when(F.col("kind").isNull(), F.array().cast("array<string>"))
            .when(F.size(F.coalesce(targets, nothing)) == 0, nothing)
            .otherwise(F.coalesce(targets, nothing)),
            "closing": F.coalesce(closing, F.lit(False)),
            "value": F.when(F.col("attribute").isNotNull(),
                            textops.strip_ws(F.regexp_extract(line, ATTRIBUTE_LINE, 2))),
        }
    )
    return completed


def statements(records: DataFrame) -> DataFrame:
    """Numbered statements per record before the per-record limit.

    Input: record_id, provider, actor, kind, full_text, tool (may be NULL).
    Document sections are handled by `operators.docs`.
    """
    spoken = records.filter(
        ~F.col("kind").isin("metadata", "source_status", "revision", "document_section")
        & F.col("full_text").rlike(r"(?U)\S")
    ).withColumn("actor", F.lower("actor"))
    is_result = (F.col("actor") == "tool") | F.col("kind").isin(
        "tool_result", "tool_output", "recorded_tool_result"
    )
    is_call = (F.col("kind") == "agent_proposal") & F.col("tool").isNotNull()
    whole = textops.strip_ws(F.col("full_text"))
    captured = spoken.filter(is_result | is_call).select(
        "record_id", F.lit(1).cast("long").alias("owner"),
        candidate(
            F.when(is_result, "claim").otherwise("context"), whole,
            F.when(is_result, "recorded").otherwise("proposed"),
            F.when(is_result, "recorded_tool_result").otherwise("agent_proposal"),
        ).alias("cand"),
        F.lit(1).cast("long").alias("total"),
    )
    exploded = classified_lines(spoken.filter(~(is_result | is_call))).select(
        "record_id", "line_no", "k", "closing", "attribute", "value",
        "kind", "said", "status", "category", "rationale", "priority", "dependencies", "method",
        F.posexplode_outer("targets").alias("sub", "target"),
    )
    relevant = exploded.filter(F.col("sub").isNotNull() | F.col("attribute").isNotNull()).select(
        "record_id", "line_no", "k", "closing", "attribute", "value", "sub",
        F.when(
            F.col("sub").isNotNull(),
            F.struct(
                "kind", F.col("said").alias("text"), "status", "category", "target",
                "rationale", "priority", "dependencies", "method",
            ),
        ).cast(CANDIDATE).alias("cand"),
    )

    # One shuffle by record; every later window and aggregate keeps that partitioning.
    placed = relevant.repartition("record_id")
    in_line = W.partitionBy("record_id", "line_no").orderBy("k", F.col("sub").asc_nulls_first())
    reached = placed.withColumn(
        "_closed",
        F.coalesce(
            F.count(F.when(F.col("closing"), 1)).over(in_line.rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).filter(F.when(F.col("closing") | (F.col("k") > 0), F.col("_closed") == F.col("k")).otherwise(True))
    in_record = W.partitionBy("record_id").orderBy("line_no", "k", F.col("sub").asc_nulls_first())
    numbered = reached.withColumns(
        {
            "owner": F.count("cand").over(in_record.rowsBetween(W.unboundedPreceding, 0)),
            "total": F.count("cand").over(W.partitionBy("record_id")),
        }
    ).filter("owner > 0")
    later = lambda name: F.max_by("value", F.when(F.col("attribute") == name, F.col("line_no")))
    attached = numbered.groupBy("record_id", "owner").agg(
        F.first("cand", ignorenulls=True).alias("cand"),
        F.max("total").alias("total"),
        later("rationale").alias("_rationale"),
        later("priority").alias("_priority"),
        later("dependencies").alias("_dependencies"),
    )
    c = F.col("cand")
    merged = attached.select(
        "record_id", "owner",
        c.withField("rationale", F.coalesce("_rationale", c["rationale"]))
        .withField("priority", F.coalesce("_priority", c["priority"]))
        .withField("dependencies", F.coalesce(split_dependencies(F.col("_dependencies")), c["dependencies"]))
        .alias("cand"),
        "total",
    )
    return merged.unionByName(captured)


def number_items(statements_df: DataFrame, most: int | None = None) -> DataFrame:
    """Identified items, with whole texts.

    With a limit, a record of more statements yields none (`extraction_gaps`).
    """
    if most is not None:
        statements_df = statements_df.filter(F.col("total") <= most)
    fields = statements_df.select(
        "record_id",
        (F.col("owner") - 1).cast("int").alias("item_no"),
        "cand.kind", "cand.text", "cand.status", "cand.category",
        "cand.target", "cand.rationale", "cand.priority", "cand.dependencies", "cand.method",
    )
    return fields.withColumn("item_id", item_identity())


def item_identity() -> Column:
    names = ["record_id", "item_no", "kind", "text", "status", "category", "target", "rationale", "priority"]
    return hashing.content_id(
        *[F.col(n) for n in names], F.to_json("dependencies"), F.col("method")
    )


def extract_items(records: DataFrame) -> DataFrame:
    return number_items(statements(records))


def extraction_gaps(statements_df: DataFrame, most: int = P.MAX_ITEMS_PER_RECORD) -> DataFrame:
    """Records of more statements than a limit."""
    return (
        statements_df.filter(F.col("total") > most)
        .groupBy("record_id")
        .agg(F.max("total").alias("statements"))
        .withColumn("code", F.lit("record_extraction_limit"))
    )


def proposed_principles(items: DataFrame, records: DataFrame, at: Column) -> DataFrame:
    """Principle statements as memory proposals awaiting acceptance."""
    null = F.lit(None).cast("string")
    return (
        items.filter("kind = 'principle'")
        .select("record_id", "text")
        .distinct()
        .join(records.select("record_id", "project_id"), "record_id")
        .select(
            hashing.content_id(F.lit("proposed_principle"), F.col("record_id"), F.col("text")).alias("memory_id"),
            F.lit("principle").alias("kind"),
            "text",
            F.lit("proposed").alias("status"),
            F.lit("inferred").alias("origin"),
            F.coalesce("project_id", F.lit("unassociated")).alias("scope"),
            F.array("record_id").alias("refs"),
            F.lit("Stated in a source; takes effect only once accepted.").alias("reason"),
            at.alias("created_at"), at.alias("updated_at"),
            null.alias("supersedes"), null.alias("exceptions"), null.alias("conflicts"),
        )
    )
