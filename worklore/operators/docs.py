"""Project documents: sections, statements, and comparison with committed content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import schema, session
from ..functions import hashing, pathops, patterns as P, textops
from ..functions.plans import settle
from . import extract
from .prose import prose_lines

_LINE = "struct<pos:int,label:string,starts:boolean,level:int,title:string,line:string>"
_STATE = f"struct<skip:boolean,comment:boolean,fence:string,inside:string,lazy:boolean,out:array<{_LINE}>>"


def _looks(line: Column, following: Column) -> list[Column]:
    """What a line shows by itself, and the level of the underline that follows it (0: none).

    A regular expression runs only where the characters it needs are there.
    """
    has = lambda mark: F.contains(line, F.lit(mark))
    first = F.substring(F.ltrim(line), 1, 1)
    under = F.when(
        F.substring(F.ltrim(following), 1, 1).isin("=", "-") & following.rlike(P.cs(P.MARKDOWN_UNDERLINE)),
        F.when(F.ltrim(following).startswith("="), 1).otherwise(2),
    )
    return [
        has("<!--").alias("opened"),
        F.when(first == "#", F.regexp_extract(line, P.cs(P.MARKDOWN_HEADING), 1)).otherwise("").alias("hashes"),
        F.when(first.isin("`", "~"), F.regexp_extract(line, P.cs(P.MARKDOWN_FENCE), 1)).otherwise("").alias("token"),
        # Printable ASCII is never blank; anything else is left to the expression.
        F.when(first.between("!", "~"), False).otherwise(~line.rlike(r"(?U)\S")).alias("blank"),
        (line.startswith("    ") | line.startswith("\t")).alias("indented"),
        ((first == ">") & line.rlike(P.MARKDOWN_QUOTED)).alias("quoted"),
        F.coalesce(under, F.lit(0)).alias("under"),
    ]


def _labelled(text: Column) -> Column:
    """Fold over the lines of a document: what each line is, and where blocks are forced to start."""
    split = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    # Bound once: a lambda would split the text again for every line.
    numbered = textops.let(
        split,
        lambda lines: F.transform(lines, lambda l, i: F.struct(i.alias("pos"), l.alias("line"), *_looks(l, F.get(lines, i + 1)))),
    )

    def step(s: Column, e: Column) -> Column:
        line, hashes, token, blank = e["line"], e["hashes"], e["token"], e["blank"]
        in_comment = ~s["skip"] & (s["comment"] | e["opened"])
        fenced = s["fence"].isNotNull()
        free = ~s["skip"] & ~in_comment & ~fenced
        heading = free & (hashes != "")
        underlined = free & ~heading & (token == "") & ~blank & ~e["indented"] & ~e["quoted"] & (e["under"] > 0)
        opens = free & ~heading & ~underlined & (token != "")
        closes = (
            ~s["skip"] & ~in_comment & fenced & (token != "")
            & (F.substring(token, 1, 1) == F.substring(s["fence"], 1, 1))
            & (F.length(token) >= F.length(s["fence"]))
            & ~F.regexp_replace(line, P.cs(P.MARKDOWN_FENCE), "").rlike(r"(?U)\S")
        )
        ordinary = free & ~heading & ~underlined & ~opens
        lazy = F.when(ordinary & blank, False).when(ordinary & e["quoted"], True).otherwise(s["lazy"])
        label = (
            F.when(s["skip"], "none")
            .when(in_comment, "comment")
            .when(heading | underlined, "heading")
            .when(opens | fenced, "fence:" )
            .when(blank, "none")
            .when(e["indented"], "code")
            .when(lazy, "quote")
            .otherwise("prose")
        )
        inside = F.when(opens, "code").when(in_comment & fenced, "quote").otherwise(s["inside"])
        entry = F.struct(
            e["pos"].alias("pos"),
            F.when(label == "fence:", F.concat(label, F.coalesce(inside, F.lit("code")))).otherwise(label).alias("label"),
            (opens | (in_comment & ~s["comment"])).alias("starts"),
            F.when(heading, F.length(hashes)).when(
                underlined, e["under"]).cast("int").alias("level"),
            F.when(heading, F.regexp_extract(line, P.cs(P.MARKDOWN_HEADING), 2))
            .when(underlined, textops.strip_ws(line)).alias("title"),
            line.alias("line"),
        )
        return F.struct(
            underlined.alias("skip"),
            (in_comment & ~F.contains(line, F.lit("-->"))).alias("comment"),
            F.when(opens, token).when(closes, F.lit(None).cast("string")).otherwise(s["fence"]).alias("fence"),
            inside.alias("inside"),
            lazy.alias("lazy"),
            F.concat(s["out"], F.array(entry)).alias("out"),
        ).cast(_STATE)

    null = F.lit(None).cast("string")
    start = F.struct(
        F.lit(False).alias("skip"), F.lit(False).alias("comment"), null.alias("fence"),
        null.alias("inside"), F.lit(False).alias("lazy"),
        F.array().cast(f"array<{_LINE}>").alias("out"),
    ).cast(_STATE)
    return textops.let(numbered, lambda n: textops.gathered(n, start, step, "out"))


_PIECE = "struct<text:string,line_start:int,line_end:int>"


def _chunks(lines: Column, limit: int) -> Column:
    """Pack the (pos, line) entries of one block into texts of at most `limit` characters."""
    state = f"struct<cur:{_PIECE},out:array<{_PIECE}>>"
    piece = lambda text, start, end: F.struct(
        text.alias("text"), start.alias("line_start"), end.alias("line_end")
    ).cast(_PIECE)

    def step(s: Column, e: Column) -> Column:
        cur, number = s["cur"], (e["pos"] + 1).cast("int")
        empty = F.length(cur["text"]) == 0
        room = limit - F.length(cur["text"])
        fits = F.length(e["line"]) <= room
        whole = F.length(e["line"]) <= limit
        joined = F.concat(cur["text"], e["line"])
        cuts = F.ceil(F.length(joined) / F.lit(limit)).cast("int")
        cut = lambda k: piece(
            F.substr(joined, k * limit + 1, F.lit(limit)),
            F.when((k == 0) & ~empty, cur["line_start"]).otherwise(number), number,
        )
        pieces = F.transform(F.sequence(F.lit(0), cuts - 1), cut)
        new_cur = (
            F.when(fits, piece(joined, F.when(empty, number).otherwise(cur["line_start"]), number))
            .when(whole, piece(e["line"], number, number))
            .otherwise(F.element_at(pieces, -1))
        )
        out = (
            F.when(fits, s["out"])
            .when(whole, F.array_append(s["out"], cur))
            .otherwise(F.concat(s["out"], F.slice(pieces, F.lit(1), F.size(pieces) - 1)))
        )
        return F.struct(new_cur.alias("cur"), out.alias("out")).cast(state)

    zero = F.struct(
        piece(F.lit(""), F.lit(0), F.lit(0)).alias("cur"), F.array().cast(f"array<{_PIECE}>").alias("out")
    ).cast(state)
    return F.aggregate(lines, zero, step, lambda s: F.array_append(s["out"], s["cur"]))


def sectionize(documents: DataFrame, id_column: str = "document_id", text_column: str = "text") -> DataFrame:
    """Sections of each document in order, under heading breadcrumbs.

    Columns: id, number, section, text, line_start, line_end, source_context,
    segment_order, segment_count, sections.
    """
    lines = documents.select(
        F.col(id_column), F.inline_outer(_labelled(F.col(text_column)))
    ).filter("pos is not null")
    doc = W.partitionBy(id_column)
    order = doc.orderBy("pos")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    # A heading of depth d holds until a heading of depth <= d; keep the last of each depth.
    marks = {}
    for depth in range(1, 7):
        marks[f"_h{depth}"] = F.last(
            F.when(F.col("level") == depth, F.struct("pos", "title")), ignorenulls=True
        ).over(running)
    content = (F.col("label") != "none") & (F.col("label") != "heading")
    previous = F.lag("label").over(order)
    # A comment may end and another begin on adjacent lines; `starts` marks openings.
    begins = content & (
        F.col("starts") | previous.isNull() | (previous != F.col("label"))
        | previous.isin("none", "heading")
    )
    tagged = lines.withColumns({**marks, "_begins": begins}).withColumn(
        "_block", F.sum(F.when(F.col("_begins"), 1).otherwise(0)).over(running)
    ).filter(content)
    titles = []
    for depth in range(1, 7):
        mark = F.col(f"_h{depth}")
        alive = mark.isNotNull()
        for higher in range(1, depth):
            alive = alive & (
                F.col(f"_h{higher}").isNull() | (F.col(f"_h{higher}")["pos"] < mark["pos"])
            )
        titles.append(F.when(alive, mark["title"]))
    section = F.array_join(F.filter(F.array(*titles), lambda t: t.isNotNull()), " > ")
    blocks = (
        tagged.withColumn("section", section)
        .groupBy(id_column, "_block")
        .agg(
            F.first("section").alias("section"),
            F.min_by("label", "pos").alias("_label"),
            F.sort_array(F.collect_list(F.struct("pos", F.concat("line", F.lit("\n")).alias("line")))).alias("_lines"),
        )
        .select(
            id_column, "_block", "section",
            F.when(F.col("_label").isin("comment", "fence:quote", "quote"), "quote")
            .when(F.col("_label").isin("fence:code", "code"), "code")
            .otherwise("prose").alias("source_context"),
            F.posexplode_outer(_chunks(F.col("_lines"), P.MAX_SEGMENT)).alias("_chunk", "_piece"),
        )
        .filter(F.col("_piece.text").rlike(r"(?U)\S"))
    )
    place = W.partitionBy(id_column).orderBy("_block", "_chunk")
    in_section = W.partitionBy(id_column, "section")
    return blocks.select(
        id_column,
        (F.row_number().over(place) - 1).alias("number"),
        "section",
        F.regexp_replace("_piece.text", r"[\r\n]+\z", "").alias("text"),
        "_piece.line_start", "_piece.line_end", "source_context",
        F.row_number().over(in_section.orderBy("_block", "_chunk")).alias("segment_order"),
        F.count(F.lit(1)).over(in_section).cast("int").alias("segment_count"),
        F.count(F.lit(1)).over(W.partitionBy(id_column)).alias("sections"),
    )


def section_records(documents: DataFrame, observed_at: Column, most: int | None = None) -> DataFrame:
    """Identified records for the sections of registered documents.

    Input: document_id, relative_path, root_path, fingerprint, text and optional
    git_head, committed_blob, tracked, modified.  Documents of more than
    `most` sections give no records (`section_gaps`); by default there is no limit.
    """
    from .normalize import with_identity

    names = ["git_head", "committed_blob", "tracked", "modified"]
    given = [n for n in names if n in documents.columns]
    sections = sectionize(documents)
    if most is not None:
        sections = sections.filter(F.col("sections") <= most)
    facts = documents.select(
        F.col("document_id").alias("_doc"), "relative_path", "root_path", "fingerprint", *given
    )
    joined = sections.join(facts, F.col("document_id") == F.col("_doc"))
    meta = schema.metadata(
        document_id=F.col("document_id"), relative_path=F.col("relative_path"),
        section=F.col("section"), source_context=F.col("source_context"),
        line_start=F.col("line_start"), line_end=F.col("line_end"),
        segment_order=F.col("segment_order"), segment_count=F.col("segment_count"),
        fingerprint=F.col("fingerprint"), observed_at=observed_at,
        content_scope=F.lit("working_tree"), **{n: F.col(n) for n in given},
    )
    number = F.col("number").cast("string")
    cleaned = joined.select(
        F.concat_ws("/", "root_path", "relative_path").alias("source_path"),
        F.col("number").cast("long").alias("line_no"),
        F.concat(
            F.col("relative_path"), F.lit(":lines:"), F.col("line_start").cast("string"), F.lit("-"),
            F.col("line_end").cast("string"), F.lit(":segment:"), number,
        ).alias("locator"),
        F.lit(P.PROVIDER_DOCUMENT).alias("provider"),
        F.col("document_id").alias("session_native_id"),
        F.concat(F.lit("section:"), number).alias("native_id"),
        F.lit("document").alias("actor"),
        F.lit("document_section").alias("kind"),
        textops.redact(F.col("text"), None).alias("full_text"),
        F.lit(None).cast("string").alias("original_time"),
        F.col("root_path").alias("cwd"),
        meta.alias("metadata"),
    )
    return with_identity(cleaned)


def section_gaps(sections: DataFrame, most: int = P.MAX_SECTIONS, id_column: str = "document_id") -> DataFrame:
    return (
        sections.filter(F.col("sections") > most).select(id_column).distinct()
        .withColumn("code", F.lit("document_section_limit"))
    )


def working_tree_state(documents: DataFrame, tree: DataFrame) -> DataFrame:
    """Compare raw bytes with the committed blob: modified is true, false or unknown."""
    known = tree.select(
        F.col("root_path").alias("_root"), F.col("relative_path").alias("_rel"),
        "committed_blob", "tracked", "git_head",
    )
    joined = documents.join(
        known, (F.col("root_path") == F.col("_root")) & (F.col("relative_path") == F.col("_rel")), "left"
    )
    blob = F.col("committed_blob")
    modified = (
        F.when(blob.isNotNull(), (hashing.blob_id(F.col("content"), blob) != blob).cast("string"))
        .when(~F.col("tracked"), "true")
        .otherwise("unknown")
    )
    return joined.withColumns(
        {
            "modified": modified,
            "committed_blob": F.coalesce(blob, F.lit("unknown")),
            "tracked": F.coalesce(F.col("tracked").cast("string"), F.lit("unknown")),
        }
    ).drop("_root", "_rel")


def document_statements(records: DataFrame) -> DataFrame:
    """Statements of document sections, numbered like `extract.statements`.

    Input: record_id, full_text, section, relative_path, line_start, source_context.
    """
    m = textops.matches
    name = F.lower(pathops.base_name(F.col("relative_path")))
    base = records.filter(F.col("kind") == "document_section").select(
        "record_id", "full_text", "source_context", "line_start",
        F.coalesce("section", F.lit("")).alias("section"), name.alias("name"),
    )
    section = F.col("section")
    relevant = base.filter(~m(section, P.EXAMPLE) & ~m(section, P.EXAMPLE_SECTION)).withColumn(
        "old_section", m(section, P.HISTORICAL) | m(F.col("name"), P.ARCHIVED_NAME)
    )
    # Code and prose both read them; sections would be made anew for each.
    relevant = session.stage(relevant, "sections")

    # Reported results quoted in code blocks.
    old = F.col("old_section")
    code = relevant.filter(
        (F.col("source_context") == "code") & m(section, P.RESULT_SECTION)
        & ~m(F.col("full_text"), P.EXAMPLE)
    )
    reported = code.select(
        "record_id", "old_section",
        F.posexplode_outer(
            F.array_distinct(F.transform(F.split("full_text", "\n"), lambda l: textops.prose(l)))
        ).alias("line_no", "said"),
    ).filter(m(F.col("said"), P.REPORTED_RESULT))
    reported = reported.select(
        "record_id", "line_no", F.lit(0).alias("sub"),
        extract.candidate(
            "claim", F.col("said"),
            F.when(old, "historical").otherwise("unverified"),
            F.when(old, "documented_history").otherwise("documented_claim"),
            rationale=F.lit("Quoted document result summary; not executed or independently verified."),
            method="document-reported-result-v1",
        ).alias("cand"),
    )

    # Prose paragraphs: list/table bodies stay line by line, plain prose is one paragraph.
    prose = relevant.filter(F.coalesce("source_context", F.lit("prose")) == "prose")
    kept = ("section", "name", "line_start", "old_section", "plain")
    lines = prose_lines(
        prose.withColumn("plain", ~F.col("full_text").rlike(P.cs(P.STRUCTURED_BODY))), keep=kept
    )
    listed = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    whole = F.struct(
        F.get("_lines", F.lit(0))["line_no"].alias("line_no"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), " ").alias("line"),
    )
    paragraphs = (
        lines.groupBy("record_id", *kept).agg(listed.alias("_lines"))
        .select("record_id", *kept, F.inline(F.when(F.col("plain"), F.array(whole)).otherwise(F.col("_lines"))))
        .filter(~F.ltrim("line").startswith("#") & ~F.ltrim("line").startswith("<!--"))
    )
    indexed = settle(paragraphs.withColumn(
        "index", F.row_number().over(W.partitionBy("record_id").orderBy("line_no")) - 1
    ).withColumn("text", textops.prose(F.col("line"))))
    text = F.col("text")
    trimmed = F.when(
        m(text, P.INLINE_EXAMPLE),
        F.rtrim(F.regexp_replace(F.element_at(F.split(text, P.ci(P.INLINE_EXAMPLE), 2), 1), r"[ :;,]+$", "")),
    ).otherwise(text)
    usable = settle(indexed.withColumn("text", trimmed)).filter(
        (text != "") & ~text.startswith("| ---") & ~text.startswith("---")
        & ~text.startswith("BEGIN ") & ~text.startswith("END ") & ~m(text, P.EXAMPLE)
    )
    task = F.regexp_extract(text, P.ci(P.DOCUMENT_TASK), 1)
    directive = F.when(task != "", task).otherwise(text)
    clauses = F.split(F.col("directive"), P.cs(P.CLAUSE_BREAK))
    status_text = F.array_join(
        F.filter(clauses, lambda c: ~c.rlike(P.ci(P.PROHIBITION_START))), " "
    )
    table = text.startswith("|")
    facts = settle(usable.withColumns({"directive": directive, "marked": task != ""}).withColumn(
        "stated", status_text
    ))
    stated = F.col("stated")
    action = m(stated, P.DOCUMENT_IMPERATIVE) & (F.col("marked") | m(section, P.PENDING_SECTION))
    reference_only = m(F.col("name"), P.REFERENCE_NAME) & ~F.col("action") & ~m(stated, P.STRONG_PENDING)
    flagged = settle(settle(facts.withColumn("action", action)).withColumns(
        {
            "pending": (m(stated, P.PENDING) | F.col("action")) & ~reference_only,
            "gap": m(stated, P.CHECK_WORD) & m(stated, P.UNAVAILABLE_WORD),
            "skip_table": table & (
                text.rlike(P.TABLE_RULE) | m(text, P.TABLE_HEADER) | ~m(section, P.TABLE_SECTION)
            ),
        }
    ))
    waiting = F.col("pending") | F.col("gap")
    limited = ~F.col("action") & m(stated, P.LIMITATION) & ~m(stated, P.PRODUCT_SCOPE)
    rung = (
        F.when(F.col("skip_table"), F.lit(None))
        .when(m(section, P.DEFERRED) | m(stated, P.DEFERRED), "deferred")
        .when(m(stated, P.NEGATED_PENDING), "claim")
        .when(old | m(F.col("directive"), r"^(?:historical\b|earlier\b)"), "history")
        .when(
            m(F.col("directive"), P.DOCUMENT_CONDITIONAL_START)
            | m(F.col("directive"), P.AUTHORIZATION) & ~waiting,
            "constraint",
        )
        .when(waiting & limited, "limitation")
        .when(waiting, F.when(textops.is_blocked(stated), "blocker").otherwise("task"))
        .when(m(text, P.DECISION_VERB) & m(section, P.DECISION_SECTION), "decision")
        .when(m(text, P.VERSION_CHANGE) | m(text, P.RAN_RESULT) & ~m(text, P.RULE_WORD), "claim")
        .when(m(text, P.RESULT_QUALIFICATION), "limitation")
        .when(m(text, P.CONDITION), "constraint")
        .when(m(text, P.LIMITATION) & m(text, P.LIMITATION_GAP), "limitation")
        .when(m(text, P.SUCCESS), "claim")
        .when(m(text, P.DECISION) & m(section, P.DECISION_SECTION), "decision")
    )
    purpose = (
        F.col("name").startswith("readme")
        & ((section == "") | (F.coalesce("line_start", F.lit(9999)) < 14))
        & (F.col("index") < 3) & ~table
        & (~F.contains(section, F.lit(" > ")) | m(section, P.PURPOSE_SECTION))
        & ~m(text, P.PURPOSE_STATUS)
    )
    ruled = flagged.withColumns({"rung": rung, "purpose": purpose})
    rules = {
        "deferred": ("context", "deferred", "documented_deferred"),
        "claim": ("claim", "unverified", "documented_claim"),
        "history": ("context", "historical", "documented_history"),
        "constraint": ("constraint", "documented", "documented_constraint"),
        "limitation": ("limitation", "documented", "documented_limitation"),
        "blocker": ("blocker", "blocked", "documented_pending"),
        "task": ("task", "pending", "documented_pending"),
        "decision": ("decision", "documented", "documented_decision"),
        "purpose": ("purpose", "documented", "documented_purpose"),
    }
    field = lambda i: F.element_at(
        F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v[i])]), F.col("label")
    )
    said = ruled.select(
        "record_id", "line_no", "text",
        F.posexplode_outer(F.array(F.when(F.col("purpose"), "purpose"), F.col("rung"))).alias("sub", "label"),
    ).filter("label is not null").select(
        "record_id", "line_no", "sub",
        extract.candidate(field(0), text, field(1), field(2), method="document-prose-v1").alias("cand"),
    )
    found = said.unionByName(reported)
    per_record = W.partitionBy("record_id")
    return found.select(
        "record_id",
        F.row_number().over(per_record.orderBy("line_no", "sub")).cast("long").alias("owner"),
        "cand",
        F.count(F.lit(1)).over(per_record).alias("total"),
    )


def document_items(records: DataFrame) -> DataFrame:
    return extract.number_items(document_statements(records))
