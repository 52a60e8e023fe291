"""Compact per-project briefing: ranked facets of document statements, and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import patterns as P, textops


def distinct_top(
    df: DataFrame, per: Sequence[str], order: Sequence[Column], limit: int, rank: str = "facet_rank"
) -> DataFrame:
    """First `limit` rows per group, equal wording in one worktree counted once."""
    once = W.partitionBy(*per, "worktree_id", "text").orderBy(*order)
    first = df.withColumn("_d", F.row_number().over(once)).filter("_d = 1").drop("_d")
    place = W.partitionBy(*per).orderBy(*order)
    return first.withColumn(rank, F.row_number().over(place)).filter(F.col(rank) <= limit)


def _newest_first() -> list[Column]:
    return [F.col("event_time").desc_nulls_last(), F.col("item_id").desc()]


def _section_key() -> Column:
    """Source section of an item; NULL when the source has neither path nor section."""
    known = (
        F.col("worktree_id").isNotNull() | F.col("relative_path").isNotNull() | F.col("section").isNotNull()
    )
    return F.when(
        known, F.to_json(F.struct("worktree_id", "relative_path", "section"), {"ignoreNullFields": "false"})
    )


def _member(sections: str) -> Column:
    return F.coalesce(F.array_contains(F.col(sections), _section_key()), F.lit(False))


def claim_rank() -> list[Column]:
    text = F.col("text")
    result = textops.matches(text, P.CLAIM_RESULT)
    scoped = result & textops.matches(text, P.CLAIM_SCOPE)
    return [
        (F.col("category") == "documented_history").asc(),
        (~scoped).asc(),
        (~textops.matches(text, P.RESULT_QUALIFICATION)).asc(),
        (~(result & textops.matches(text, P.CLAIM_NUMBER))).asc(),
        (~(result | textops.matches(text, P.VERSION_CHANGE))).asc(),
        textops.matches(text, P.CLAIM_NEGATIVE).asc(),
        F.length(text).asc(),
        F.col("item_id").asc(),
    ]


def _attach(df: DataFrame, small: DataFrame, column: str) -> DataFrame:
    """Add a bounded per-project value."""
    keyed = small.select(F.col("project_id").alias("_p"), column)
    return df.join(keyed, df.project_id.eqNullSafe(F.col("_p")), "left").drop("_p")


def brief_facets(items: DataFrame) -> DataFrame:
    """Ranked facet entries per project: facet, facet_rank and the item columns.

    Input: resolved document items with source_current, relative_path, section.
    Each cut is a per-project top-k, so group size does not matter; the word and
    section sets joined back hold at most a facet's worth of entries.
    """
    active = items.filter(F.col("source_current") & ~F.col("status").isin(P.CLOSED_FOR_BRIEF))
    text, size = F.col("text"), F.length("text")
    lower = F.lower(text)
    mentions = F.size(F.split(lower, "unfinished")) + F.size(F.split(lower, "unverified"))

    pending = distinct_top(
        active.filter((F.col("category") == "documented_pending") & F.col("status").isin(P.OPEN_STATUSES)),
        ["project_id"], [(size > 1000).asc(), mentions.desc(), size.asc(), *_newest_first()],
        P.FACET_LIMITS["pending"],
    )
    pending_words = pending.groupBy("project_id").agg(
        F.array_distinct(F.flatten(F.collect_list(textops.content_words(text)))).alias("_words")
    )
    constraints = distinct_top(
        _attach(active.filter("kind = 'constraint'"), pending_words, "_words").withColumn(
            "_overlap",
            F.size(F.array_intersect(textops.content_words(text), F.coalesce("_words", F.array().cast("array<string>")))),
        ),
        ["project_id"],
        [(~textops.matches(text, P.AUTHORIZATION)).asc(), textops.matches(text, P.CONSTRAINT_FIRST).desc(),
         F.col("_overlap").desc(), size.asc(), *_newest_first()],
        P.FACET_LIMITS["constraints"],
    ).drop("_words", "_overlap")

    claims = active.filter(F.col("category").isin("documented_claim", "documented_history"))
    changes = textops.matches(text, P.VERSION_CHANGE)
    version = claims.filter(changes)
    best_version = version.withColumn(
        "_v", F.row_number().over(
            W.partitionBy("project_id").orderBy(
                (F.col("category") == "documented_history").asc(), size.desc(), F.col("item_id").asc()
            )
        ),
    ).filter("_v = 1").drop("_v")
    results = claims.filter(~changes)
    leaders = results.withColumn(
        "_l", F.row_number().over(W.partitionBy("project_id").orderBy(*claim_rank()))
    ).filter("_l <= 3")
    leading = leaders.groupBy("project_id").agg(F.collect_set(_section_key()).alias("_leading"))
    rank = claim_rank()
    ranked = distinct_top(
        _attach(results, leading, "_leading"),
        ["project_id"], [*rank[:2], (~_member("_leading")).asc(), *rank[2:]],
        P.FACET_LIMITS["claims"],
    ).drop("_leading")
    # A version description takes the last of the result slots.
    has_version = best_version.select("project_id", F.lit(1).alias("_has"))
    shown_results = _attach(ranked, has_version, "_has").filter(
        F.col("_has").isNull() | (F.col("facet_rank") < P.FACET_LIMITS["claims"])
    ).drop("_has")
    shown_claims = shown_results.unionByName(
        best_version.withColumn("facet_rank", F.lit(P.FACET_LIMITS["claims"]))
    )
    claim_sections = shown_claims.groupBy("project_id").agg(F.collect_set(_section_key()).alias("_cited"))
    qualifies = textops.matches(text, P.RESULT_QUALIFICATION)
    limitations = distinct_top(
        _attach(
            active.filter((F.col("kind") == "limitation") | (F.col("category") == "documented_deferred")),
            claim_sections, "_cited",
        ),
        ["project_id"],
        [(~(qualifies & _member("_cited"))).asc(), (~qualifies).asc(),
         textops.matches(text, P.LIMITATION_FIRST).desc(), size.asc(), *_newest_first()],
        P.FACET_LIMITS["limitations"],
    ).drop("_cited")
    decisions = distinct_top(
        active.filter("kind = 'decision'"), ["project_id"], _newest_first(), P.FACET_LIMITS["decisions"]
    )
    purpose = distinct_top(
        active.filter("kind = 'purpose'"), ["project_id"], [size.desc(), F.col("item_id").asc()],
        P.FACET_LIMITS["purpose"],
    )
    named = {
        "purpose": purpose, "pending": pending, "constraints": constraints,
        "limitations": limitations, "decisions": decisions, "claims": shown_claims,
    }
    out = None
    for name, frame in named.items():
        part = frame.withColumn("facet", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def facet_omissions(items: DataFrame, facets: DataFrame) -> DataFrame:
    """Per project: statements not shown in any facet."""
    total = items.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    shown = facets.select(F.col("project_id").alias("_p"), "item_id").distinct().groupBy("_p").agg(
        F.count(F.lit(1)).alias("shown")
    )
    return total.join(shown, total.project_id.eqNullSafe(F.col("_p")), "left").select(
        "project_id", (F.col("total") - F.coalesce("shown", F.lit(0))).alias("omitted")
    )


def topic_conflicts(items: DataFrame) -> DataFrame:
    """Topics that a source states as pending and another as done."""
    active = items.filter(F.col("source_current") & ~F.col("status").isin(P.CLOSED_FOR_BRIEF))
    keyed = active.select(
        "project_id", "category", "record_id", textops.topic_key(F.col("text")).alias("topic")
    )
    return (
        keyed.groupBy("project_id", "topic")
        .agg(
            F.count_if(F.col("category") == "documented_pending").alias("pending"),
            F.count_if(F.col("category") == "documented_claim").alias("claims"),
            F.min("record_id").alias("first_record_id"),
        )
        .filter("pending > 0 and claims > 0")
        .withColumn("code", F.lit("sources_disagree"))
    )


def project_conflicts(items: DataFrame) -> DataFrame:
    """Pending beside passing results, and pending statements that vanished."""
    active = F.col("source_current") & ~F.col("status").isin(P.CLOSED_FOR_BRIEF)
    pending = active & (F.col("category") == "documented_pending") & F.col("status").isin(P.OPEN_STATUSES)
    passing = (F.col("status") == "historical") | (F.col("category") == "documented_claim")
    vanished = F.coalesce(F.col("historical_status").isin(P.OPEN_STATUSES), F.lit(False))
    counts = items.groupBy("project_id").agg(
        F.count_if(pending).alias("pending"),
        F.count_if(passing).alias("passing"),
        F.count_if(vanished).alias("vanished"),
    )
    both = counts.filter("pending > 0 and passing > 0").select(
        "project_id", F.lit("pending_beside_results").alias("code"), F.col("pending").alias("statements")
    )
    lost = counts.filter("vanished > 0").select(
        "project_id", F.lit("pending_statements_vanished").alias("code"), F.col("vanished").alias("statements")
    )
    return both.unionByName(lost)


def unattributed_conflicts(verdicts: DataFrame) -> DataFrame:
    """Move evidence that belongs to no project."""
    return verdicts.filter("failure is not null").groupBy(F.col("failure").alias("code")).agg(
        F.count(F.lit(1)).alias("statements")
    )
