"""Ordered computations over groups of unbounded size.

A window partitioned by the group alone would put one large file or session in
a single task.  These helpers split each ordered group into segments, run the
window inside each (group, segment), summarise segments to one row each, and
carry the summaries across.  Only the summaries are windowed per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEGMENT_ROWS = 65536


def position_segment(position: Column, rows: int = SEGMENT_ROWS) -> Column:
    return F.floor(position / F.lit(rows))


def _attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [df[k].eqNullSafe(summary["_k_" + k]) for k in keys]
    joined = df.join(summary, on[0] if len(on) == 1 else _all(on), "left")
    return joined.drop(*["_k_" + k for k in keys])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    segment: str,
    order: str,
    number: str,
    weight: Column | None = None,
    offset: str | None = None,
) -> DataFrame:
    """Dense 1-based number per group, and optionally the weight before each row."""
    keys = [*group, segment]
    weight = F.lit(0) if weight is None else weight
    inner = W.partitionBy(*keys).orderBy(order)
    across = W.partitionBy(*["_k_" + g for g in group]).orderBy("_k_" + segment).rowsBetween(
        W.unboundedPreceding, -1
    )
    summary = (
        df.groupBy(*[F.col(k).alias("_k_" + k) for k in keys])
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
        .select(
            *["_k_" + k for k in keys],
            F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before_n"),
            F.coalesce(F.sum("_w").over(across), F.lit(0)).alias("_before_w"),
        )
    )
    local = df.withColumn(number, F.row_number().over(inner).cast("long"))
    if offset:
        local = local.withColumn(
            offset,
            F.coalesce(F.sum(weight).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
    out = _attach(local, summary, keys).withColumn(number, F.col(number) + F.col("_before_n"))
    if offset:
        out = out.withColumn(offset, F.col(offset) + F.col("_before_w"))
    return out.drop("_before_n", "_before_w")


def carry_forward(
    df: DataFrame, group: Sequence[str], segment: str, order: str, cols: Sequence[str]
) -> DataFrame:
    """Replace each column by its latest non-NULL value so far in the group."""
    keys = [*group, segment]
    inner = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*["_k_" + g for g in group]).orderBy("_k_" + segment).rowsBetween(
        W.unboundedPreceding, -1
    )
    summary = (
        df.groupBy(*[F.col(k).alias("_k_" + k) for k in keys])
        .agg(
            *[
                F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias("_s_" + c)
                for c in cols
            ]
        )
        .select(
            *["_k_" + k for k in keys],
            *[F.last("_s_" + c, ignorenulls=True).over(across).alias("_before_" + c) for c in cols],
        )
    )
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in cols})
    out = _attach(local, summary, keys)
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_before_" + c)) for c in cols}).drop(
        *["_before_" + c for c in cols]
    )


def next_row(
    df: DataFrame, group: Sequence[str], segment: str, order: str, value: Column, name: str
) -> DataFrame:
    """The value of the following row of the group (NULL on the last one)."""
    keys = [*group, segment]
    across = W.partitionBy(*group).orderBy(segment)
    boxed = F.struct(value.alias("v"))
    # A segment's first value also stands behind the last row of the segment before it, so no row is joined.
    firsts = df.groupBy(*keys).agg(F.min_by(boxed, F.col(order)).alias("_v")).withColumn("_has", F.lag(F.lit(True)).over(across))
    borders = firsts.select(*group, F.lag(segment).over(across).alias(segment), "_v", "_has", F.lit(True).alias("_border"))
    rows = df.withColumns({"_v": boxed, "_border": F.lit(False)})
    both = rows.unionByName(borders.filter("_has").drop("_has"), allowMissingColumns=True)
    inner = W.partitionBy(*keys).orderBy("_border", order)
    return both.withColumn(name, F.lead("_v").over(inner)["v"]).filter("not _border").drop("_v", "_border")
