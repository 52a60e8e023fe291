"""Prose lines of a record: everything that is not code, quotation or comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, textops

LINE_BREAK = r"\n|\u2028|\u2029"
_STRUCTURED = r"<!--|```|~~~|(?m)^\s*>"
_STATE = "struct<comment:boolean,fence:string,quoted:boolean,kept:array<struct<pos:int,line:string>>>"


def _outside_regions(lines: Column) -> Column:
    """Fold over the lines; keep those outside comments, fences and quotations.

    An unclosed fence consumes the remainder.
    """
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("pos"), l.alias("line")))

    def step(state: Column, entry: Column) -> Column:
        line = entry["line"]
        comment = state["comment"] | F.contains(line, F.lit("<!--"))
        unlisted = F.regexp_replace(line, P.cs(P.LIST_LINE), "")
        token = F.regexp_extract(unlisted, P.cs(P.FENCE_LINE), 1)
        rest = F.regexp_extract(unlisted, P.cs(P.FENCE_LINE), 2)
        is_fence = token != ""
        closes = (
            state["fence"].isNotNull()
            & (F.substring(token, 1, 1) == F.substring(state["fence"], 1, 1))
            & (F.length(token) >= F.length(state["fence"]))
            & ~rest.rlike(r"(?U)\S")
        )
        fence = (
            F.when(comment | ~is_fence, state["fence"])
            .when(state["fence"].isNull(), token)
            .when(closes, F.lit(None).cast("string"))
            .otherwise(state["fence"])
        )
        inert = comment | is_fence | state["fence"].isNotNull() | line.rlike(P.MARKDOWN_INDENTED)
        blank = ~line.rlike(r"(?U)\S")
        quote = line.rlike(r"(?U)^\s*>")
        quoted = (
            F.when(inert, state["quoted"]).when(blank, False).when(quote, True)
            .otherwise(state["quoted"])
        )
        keep = ~inert & ~blank & ~quoted
        return F.struct(
            (comment & ~F.contains(line, F.lit("-->"))).alias("comment"),
            fence.alias("fence"),
            quoted.alias("quoted"),
            F.when(keep, F.concat(state["kept"], F.array(entry))).otherwise(state["kept"]).alias("kept"),
        ).cast(_STATE)

    start = F.struct(
        F.lit(False).alias("comment"),
        F.lit(None).cast("string").alias("fence"),
        F.lit(False).alias("quoted"),
        F.array().cast("array<struct<pos:int,line:string>>").alias("kept"),
    ).cast(_STATE)
    return textops.let(numbered, lambda n: textops.gathered(n, start, step, "kept"))


def prose_lines(records: DataFrame, text: str = "full_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per instruction-bearing line: record_id, line_no, line (+ kept columns).

    The outer generator keeps the optimizer from evaluating the fold again in a
    "has elements" filter below it; empty rows go with the blank lines.
    """
    lines = F.split(F.col(text), LINE_BREAK)
    plain = F.transform(lines, lambda l, i: F.struct(i.alias("pos"), l.alias("line")))
    entries = F.when(F.col(text).rlike(_STRUCTURED), _outside_regions(lines)).otherwise(plain)
    exploded = records.select("record_id", *keep, F.explode_outer(entries).alias("_e")).select(
        "record_id", *keep, F.col("_e.pos").alias("line_no"), F.col("_e.line").alias("_raw")
    )
    raw = F.col("_raw")
    checked = F.regexp_extract(raw, P.cs(P.LIST_LINE), 1).rlike("[xX]")
    stripped = textops.strip_ws(raw)
    line = textops.strip_ws(F.regexp_replace(raw, P.cs(P.LIST_LINE), ""))
    return (
        exploded.filter(
            raw.rlike(r"(?U)\S")
            & ~raw.rlike(P.MARKDOWN_INDENTED)
            & ~stripped.rlike("^[\"'“‘>]")
            & ~checked
        )
        .select("record_id", *keep, "line_no", line.alias("line"))
        .filter(F.col("line") != "")
    )
