"""Registered queries over project documents: statements of every rung, and ranked briefings."""

from __future__ import annotations

from pyspark.sql import functions as F

import entry_tables as E
from entry_queries import query
from worklore.functions import patterns as P
from worklore.operators import docs, facets

# File, heading, body, and the item that must come of it; a percent sign stands for a number.
_TASK = ("task", "pending", "documented_pending")
_CLAIM = ("claim", "unverified", "documented_claim")
_LIMIT = ("limitation", "documented", "documented_limitation")
_RULE = ("constraint", "documented", "documented_constraint")
_CHOICE = ("decision", "documented", "documented_decision")
_NOTHING = (None, None, None)
_WRITTEN = [
    ("status.md", "Status", "Probe % is unfinished.", "Probe % is unfinished.", *_TASK),
    ("status.md", "Status", "Probe % is blocked.", "Probe % is blocked.", "blocker", "blocked", "documented_pending"),
    ("status.md", "Next steps", "Inspect probe %.", "Inspect probe %.", *_TASK),
    ("status.md", "Status", "TODO: Inspect probe %.", "TODO: Inspect probe %.", *_TASK),
    ("status.md", "Status", "A test of probe % is unavailable.", "A test of probe % is unavailable.", *_TASK),
    ("status.md", "Status", "Probe %\nis unfinished.", "Probe % is unfinished.", *_TASK),
    ("status.md", "Status", "- Probe % is unfinished.\n- [x] Probe % is blocked.", "Probe % is unfinished.", *_TASK),
    ("status.md", "Status", "| Probe | State |\n| --- | --- |\n| Probe % | unfinished |", "| Probe % | unfinished |", *_TASK),
    ("status.md", "Notes", "| Probe | State |\n| --- | --- |\n| Probe % | unfinished |", None, *_NOTHING),
    ("status.md", "Deferred", "Probe % moves on.", "Probe % moves on.", "context", "deferred", "documented_deferred"),
    ("status.md", "Status", "No pending work on probe %.", "No pending work on probe %.", *_CLAIM),
    ("status.md", "Earlier work", "Probe % moves on.", "Probe % moves on.", "context", "historical", "documented_history"),
    ("plan.md", "Work", "Probe % moves on.", "Probe % moves on.", "context", "historical", "documented_history"),
    ("status.md", "Rules", "If probe % fails we stop.", "If probe % fails we stop.", *_RULE),
    ("status.md", "Rules", "Do not restart probe %.", "Do not restart probe %.", *_RULE),
    ("status.md", "Status", "Probe % requires an allowance.", "Probe % requires an allowance.", *_RULE),
    ("status.md", "Status", "Coverage of probe % is unverified.", "Coverage of probe % is unverified.", *_LIMIT),
    ("status.md", "Status", "Probe % was never taken as proof.", "Probe % was never taken as proof.", *_LIMIT),
    ("status.md", "Status", "Coverage of probe % is missing.", "Coverage of probe % is missing.", *_LIMIT),
    ("architecture.md", "Status", "Probe % is not verified.", "Probe % is not verified.", *_LIMIT),
    ("status.md", "Decisions", "We chose probe %.", "We chose probe %.", *_CHOICE),
    ("status.md", "Decisions", "Probe % stays because it is cheap.", "Probe % stays because it is cheap.", *_CHOICE),
    ("status.md", "Status", "Schema 2 removes probe %.", "Schema 2 removes probe %.", *_CLAIM),
    ("status.md", "Status", "We ran probe %.", "We ran probe %.", *_CLAIM),
    ("status.md", "Status", "Probe % succeeded.", "Probe % succeeded.", *_CLAIM),
    ("status.md", "Tests", "```\n% checks PASS\n```", "% checks PASS", *_CLAIM),
    ("draft.md", "Tests", "```\n% checks PASS\n```", "% checks PASS", "claim", "historical", "documented_history"),
    ("status.md", "Notes", "```\n% checks PASS\n```", None, *_NOTHING),
    ("readme.md", "Overview", "Probe % lists parts.", "Probe % lists parts.", "purpose", "documented", "documented_purpose"),
    ("status.md", "Overview", "Probe % lists parts.", None, *_NOTHING),
    ("status.md", "Examples", "Probe % is blocked.", None, *_NOTHING),
    ("status.md", "Status", "A hypothetical probe % is blocked.", None, *_NOTHING),
    ("status.md", "Status", "> Probe % is unfinished.", None, *_NOTHING),
    ("status.md", "Status", "<!-- Probe % is unfinished. -->", None, *_NOTHING),
    ("status.md", "Status", "    Probe % is unfinished.", None, *_NOTHING),
]
_WRITTEN_SQL = ", ".join(
    f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in row[3:]) + ")" for i, row in enumerate(_WRITTEN)
)


@query(f"""SELECT doc_id, kind, status, category, replace(said, '%', doc_id::VARCHAR) AS text FROM documents
 JOIN (VALUES {_WRITTEN_SQL}) s(i, said, kind, status, category) ON doc_id % {len(_WRITTEN)} = i WHERE kind IS NOT NULL""")
def document_rungs(spark, sf_dir):
    """Every rung of document statements; each whole text, fenced, quoted or in a comment, adds none."""
    given = E.spread(spark, sf_dir, "documents").select("doc_id", "text")
    case, number = (F.col("doc_id") % len(_WRITTEN)).cast("int"), F.col("doc_id").cast("string")
    pick = lambda place: F.get(F.array(*[F.lit(row[place]) for row in _WRITTEN]), case)
    inert = F.regexp_replace(F.coalesce("text", F.lit("")), r"-->|```|\r", " ")
    whole = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```\n"), inert, F.lit("\n```")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<!--\n"), inert, F.lit("\n-->")))
        .otherwise(F.concat(F.lit("> "), F.regexp_replace(inert, "\n", "\n> ")))
    )
    parts = [F.lit("# "), pick(1), F.lit("\n\n"), F.replace(pick(2), F.lit("%"), number), F.lit("\n\n# Text\n\n"), whole]
    documents = given.select(
        number.alias("document_id"), pick(0).alias("relative_path"), F.concat(F.lit("/d"), number).alias("root_path"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.concat(*parts).alias("text"),
    )
    records = docs.section_records(documents, F.lit("2026-01-01").cast("timestamp"))
    flat = records.select(
        "record_id", "kind", "full_text", "session_native_id", F.col("metadata.section").alias("section"),
        F.col("metadata.relative_path").alias("relative_path"), F.col("metadata.line_start").alias("line_start"),
        F.col("metadata.source_context").alias("source_context"),
    )
    owner = flat.select("record_id", F.col("session_native_id").cast("long").alias("doc_id"))
    items = docs.document_items(flat).select("record_id", "kind", "status", "category", "text")
    return items.join(owner, "record_id").select("doc_id", "kind", "status", "category", "text")


# What the documents of a source state, in turn; a percent sign stands for one of forty numbers.
_STATED = [
    ("Probe % is unfinished.", *_TASK),
    ("The unfinished probe % has an unverified result.", *_TASK),
    ("Bridge % is unfinished and the long unverified bridge stays" + " unfinished" * 100 + ".", *_TASK),
    ("Never restart probe %.", *_RULE),
    ("Keep the probe % running.", *_RULE),
    ("Probe % requires an allowance.", *_RULE),
    ("Valve % requires a bridge result.", *_RULE),
    ("Coverage of probe % is missing.", *_LIMIT),
    ("Probe % was never taken as proof.", *_LIMIT),
    ("Known incomplete: probe %.", *_LIMIT),
    ("Valve % moves on.", "context", "deferred", "documented_deferred"),
    ("We chose probe %.", *_CHOICE),
    ("We ran probe %.", *_CLAIM),
    ("All parts passed at commit % of the valve.", *_CLAIM),
    ("Nothing returned from valve %.", *_CLAIM),
    ("Probe % succeeded.", *_CLAIM),
    ("Valve % passed but is not verified.", *_CLAIM),
    ("Bridge passed.", "context", "historical", "documented_history"),
    ("Schema % removes the valve.", *_CLAIM),
    ("Schema % adds a bridge to every probe.", "context", "historical", "documented_history"),
    ("This project watches % probes.", "purpose", "documented", "documented_purpose"),
    ("Probe % is blocked.", "blocker", "blocked", "documented_pending"),
    ("Probe % is cancelled.", "task", "cancelled", "documented_pending"),
]
_STATED_SQL = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(_STATED))
STATEMENTS = f"""
 SELECT concat('d', CAST(doc_id AS STRING)) AS item_id, source AS project_id, kind, status, category,
        replace(said, '%', CAST(doc_id % 40 AS STRING)) AS text,
        CASE WHEN doc_id % 50 <> 0 THEN concat('w', CAST(doc_id % 3 AS STRING)) END AS worktree_id,
        CASE WHEN doc_id % 50 <> 0 AND doc_id % 13 <> 0 THEN concat('f', CAST(doc_id % 4 AS STRING)) END AS relative_path,
        CASE WHEN doc_id % 50 <> 0 THEN concat('s', CAST(doc_id % 5 AS STRING)) END AS section,
        CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id % 97 AS INT) END AS event_time, doc_id % 9 <> 0 AS source_current
 FROM {{documents}} d JOIN (VALUES {_STATED_SQL}) s(i, said, kind, status, category) ON (doc_id * 7 + length(text)) % {len(_STATED)} = i
"""


def _is(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}', 'i')"


_RESULT, _QUALIFIED = _is(P.CLAIM_RESULT), _is(P.RESULT_QUALIFICATION)
_HISTORY, _SCOPED = "category = 'documented_history'", f"({_RESULT} AND {_is(P.CLAIM_SCOPE)})"
_CLAIM_REST = f"""NOT {_QUALIFIED}, NOT ({_RESULT} AND {_is(P.CLAIM_NUMBER)}), NOT ({_RESULT} OR {_is(P.VERSION_CHANGE)}),
 {_is(P.CLAIM_NEGATIVE)}, length(text), item_id"""
_NEWEST = "event_time DESC NULLS LAST, item_id DESC"
_WORDS = f"""list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in P.STOP_WORDS)}], w))"""


def _top(source: str, order: str, facet: str) -> str:
    """First rows of a facet, wording that recurs in a worktree counted once."""
    once = f"SELECT *, row_number() OVER (PARTITION BY project_id, worktree_id, text ORDER BY {order}) AS nth FROM {source}"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS facet_rank FROM ({once}) o WHERE nth = 1) p
 WHERE facet_rank <= {P.FACET_LIMITS[facet]}"""


BRIEF_SQL = f"""
WITH st AS ({E.for_check(STATEMENTS, "documents")}),
act AS (SELECT *, CASE WHEN worktree_id IS NOT NULL OR relative_path IS NOT NULL OR section IS NOT NULL
    THEN concat(coalesce(worktree_id, '-'), '/', coalesce(relative_path, '-'), '/', coalesce(section, '-')) END AS place
  FROM st WHERE source_current AND status <> 'cancelled'),
pend AS ({_top("(SELECT * FROM act WHERE category = 'documented_pending')",
    f"length(text) > 1000, length(replace(replace(text, 'unfinished', ''), 'unverified', '')) - length(text), length(text), {_NEWEST}", "pending")}),
said AS (SELECT project_id, list_distinct(flatten(list({_WORDS}))) AS known FROM pend GROUP BY 1),
rules AS ({_top(f"(SELECT act.*, len(list_intersect({_WORDS}, coalesce(known, []))) AS shared FROM act LEFT JOIN said ON act.project_id IS NOT DISTINCT FROM said.project_id WHERE kind = 'constraint')",
    f"NOT {_is(P.AUTHORIZATION)}, {_is(P.CONSTRAINT_FIRST)} DESC, shared DESC, length(text), {_NEWEST}", "constraints")}),
cl AS (SELECT * FROM act WHERE category IN ('documented_claim', 'documented_history')),
ver AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_HISTORY}, length(text) DESC, item_id) AS v FROM cl WHERE {_is(P.VERSION_CHANGE)}) x WHERE v = 1),
res AS (SELECT * FROM cl WHERE NOT {_is(P.VERSION_CHANGE)}),
ahead AS (SELECT project_id, list(place) AS fronts FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_HISTORY}, NOT {_SCOPED}, {_CLAIM_REST}) AS l FROM res) x WHERE l <= 3 GROUP BY 1),
best AS ({_top("(SELECT res.*, coalesce(list_contains(fronts, place), false) AS led FROM res JOIN ahead ON res.project_id IS NOT DISTINCT FROM ahead.project_id)",
    f"{_HISTORY}, NOT {_SCOPED}, NOT led, {_CLAIM_REST}", "claims")}),
shown AS (SELECT project_id, item_id, place, facet_rank FROM best WHERE facet_rank < 7 OR NOT EXISTS (SELECT 1 FROM ver WHERE ver.project_id IS NOT DISTINCT FROM best.project_id)
  UNION ALL SELECT project_id, item_id, place, 7 FROM ver),
cited AS (SELECT project_id, list(place) AS cited FROM shown GROUP BY 1),
lim AS ({_top("(SELECT act.*, coalesce(list_contains(cited, place), false) AS near FROM act LEFT JOIN cited ON act.project_id IS NOT DISTINCT FROM cited.project_id WHERE kind = 'limitation' OR category = 'documented_deferred')",
    f"NOT ({_QUALIFIED} AND near), NOT {_QUALIFIED}, {_is(P.LIMITATION_FIRST)} DESC, length(text), {_NEWEST}", "limitations")}),
dec AS ({_top("(SELECT * FROM act WHERE kind = 'decision')", _NEWEST, "decisions")}),
pur AS ({_top("(SELECT * FROM act WHERE kind = 'purpose')", "length(text) DESC, item_id", "purpose")}),
every AS (SELECT 'pending' AS facet, project_id, item_id, facet_rank FROM pend UNION ALL SELECT 'constraints', project_id, item_id, facet_rank FROM rules
  UNION ALL SELECT 'claims', project_id, item_id, facet_rank FROM shown UNION ALL SELECT 'limitations', project_id, item_id, facet_rank FROM lim
  UNION ALL SELECT 'decisions', project_id, item_id, facet_rank FROM dec UNION ALL SELECT 'purpose', project_id, item_id, facet_rank FROM pur)
SELECT facet, coalesce(project_id, '-') AS project_id, item_id, facet_rank::BIGINT AS facet_rank FROM every
UNION ALL SELECT 'omitted', coalesce(st.project_id, '-'), '-', count(*) - (SELECT count(DISTINCT item_id) FROM every WHERE every.project_id IS NOT DISTINCT FROM st.project_id)
FROM st GROUP BY st.project_id
"""


@query(BRIEF_SQL)
def briefing_facets(spark, sf_dir):
    """All six facets of every source, and how many of its statements none of them shows."""
    items = E.derived(spark, sf_dir, STATEMENTS, "documents")
    shown = facets.brief_facets(items)
    left = facets.facet_omissions(items, shown).select(
        F.lit("omitted").alias("facet"), "project_id", F.lit("-").alias("item_id"), F.col("omitted").alias("facet_rank")
    )
    return shown.select("facet", "project_id", "item_id", "facet_rank").unionByName(left).select(
        "facet", F.coalesce("project_id", F.lit("-")).alias("project_id"), "item_id", F.col("facet_rank").cast("long").alias("facet_rank")
    )
