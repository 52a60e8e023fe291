"""Registered query over the whole resume: every relation of every project, against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

import entry_tables as E
from entry_queries import query
from entry_store import _move_tables
from worklore import schema, session
from worklore.operators import moves
from worklore.plans import resume

# One record per event; what it is depends on event_id % 6.
_RECORDS = """
 SELECT event_id AS n, concat('r', CAST(event_id AS STRING)) AS record_id, concat('i', CAST(event_id AS STRING)) AS item_id,
  CASE WHEN event_id % 6 = 4 THEN 'project_document' ELSE 'codex' END AS provider,
  concat(CASE WHEN event_id % 6 = 4 THEN 'd' ELSE 's' END, CAST(user_id AS STRING)) AS session_id,
  concat('n', CAST(event_id AS STRING)) AS native_id,
  CASE event_id % 6 WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' WHEN 4 THEN 'document' WHEN 5 THEN 'system' ELSE 'user' END AS actor,
  CASE event_id % 6 WHEN 1 THEN 'agent_claim' WHEN 2 THEN 'recorded_tool_result' WHEN 4 THEN 'document_section' WHEN 5 THEN 'metadata'
   ELSE 'user_intent' END AS kind,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 5 < 3 THEN 'Please replace the probe procedure.' ELSE 'Please repair the probe.' END
   WHEN 1 THEN 'Probe is repaired.' WHEN 2 THEN 'result=ok' WHEN 3 THEN 'Keep the probe, which is unclear.'
   WHEN 4 THEN concat('Probe group ', CAST(event_id % 30 AS STRING), ' stands.') ELSE '' END AS text,
  CASE WHEN event_id % 6 <> 4 AND event_id % 50 <> 0 THEN CAST(ts AS TIMESTAMP) END AS event_time,
  CASE WHEN event_id % 6 = 4 OR event_id % 50 = 0 THEN 'missing' ELSE 'known' END AS time_status,
  CASE WHEN user_id % 11 <> 0 THEN concat('p', CAST(user_id % 7 AS STRING)) END AS project_id,
  CASE WHEN user_id % 11 <> 0 THEN concat('w', CAST(user_id % 14 AS STRING)) END AS worktree_id,
  CASE WHEN event_id % 6 = 5 THEN 'turn_aborted' END AS event_type,
  CASE WHEN event_id % 6 = 2 AND event_id % 9 > 2 THEN concat('rev', CAST(event_id % 4 AS STRING)) END AS revision,
  CASE WHEN event_id % 6 = 2 THEN CAST(0 AS BIGINT) END AS exit_status,
  CASE WHEN event_id % 6 = 4 THEN concat('f', CAST(event_id % 4 AS STRING)) END AS relative_path,
  CASE WHEN event_id % 6 = 4 THEN concat('s', CAST(event_id % 5 AS STRING)) END AS section,
  concat('g', CAST(user_id % 20 AS STRING), '-', CASE WHEN event_id % 10 = 0 THEN '1' ELSE '2' END) AS generation_id,
  CAST(ts AS TIMESTAMP) AS at
 FROM {events}
"""
# Statements of records: (kind, status, category) by event_id % 12; half of the sections are pending work, half claims.
_SAID = """
 SELECT r.*, CASE n % 12 WHEN 0 THEN 'task' WHEN 6 THEN 'next_action' WHEN 1 THEN 'claim' WHEN 7 THEN 'claim' WHEN 3 THEN 'decision'
   WHEN 9 THEN 'objective' WHEN 4 THEN 'task' ELSE 'claim' END AS item_kind,
  CASE n % 12 WHEN 0 THEN 'active' WHEN 6 THEN 'active' WHEN 3 THEN CASE WHEN n % 5 = 0 THEN 'cancelled' ELSE 'accepted' END
   WHEN 9 THEN 'active' WHEN 4 THEN 'pending' ELSE 'reported' END AS item_status,
  CASE n % 12 WHEN 1 THEN 'agent_claim' WHEN 7 THEN 'agent_claim' WHEN 4 THEN 'documented_pending' WHEN 10 THEN 'documented_claim'
   ELSE 'user_intent' END AS category
 FROM ({records}) r WHERE n % 6 NOT IN (2, 5)
"""
_TREES = """
 SELECT DISTINCT concat('w', CAST(user_id % 14 AS STRING)) AS worktree_id, concat('p', CAST(user_id % 7 AS STRING)) AS project_id,
  user_id % 14 AS number, user_id % 14 % 3 <> 0 AS active FROM {events}
"""

_R = E.for_check(_RECORDS)
_S = _SAID.format(records=_R)
_OPEN = "('active', 'pending', 'blocked')"
_NEWEST = "event_time DESC NULLS LAST"
_RANKED = f"""ORDER BY category <> 'documented_pending' OR status NOT IN {_OPEN},
  CASE WHEN status IN {_OPEN} THEN CASE kind WHEN 'next_action' THEN 1 WHEN 'task' THEN 2 WHEN 'decision' THEN 3 ELSE 4 END ELSE 5 END,
  {_NEWEST}, item_id DESC"""


def _facet(category: str) -> str:
    """Sections of a category that still hold, wording that recurs in a worktree counted once."""
    return f"""SELECT project_id, count(DISTINCT row(worktree_id, text)) AS rows FROM it
  WHERE provider = 'project_document' AND source_current AND category = '{category}' GROUP BY 1"""


SQL = f"""
WITH rec AS ({_R}), trees AS ({E.for_check(_TREES)}), src AS ({E.for_check(E.SOURCES)}),
gen AS ({E.for_check(E.GENERATIONS)}),
cur AS (SELECT record_id FROM rec JOIN gen USING (generation_id) WHERE gen.status = 'current'),
it AS (SELECT s.* EXCLUDE (kind), s.item_kind AS kind, c.record_id IS NOT NULL AS source_current,
  CASE WHEN c.record_id IS NULL AND item_status IN {_OPEN} THEN 'source_superseded' ELSE item_status END AS status,
  c.record_id IS NULL AND item_status IN {_OPEN} AS vanished FROM ({_S}) s LEFT JOIN cur c ON c.record_id = s.record_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY project_id {_RANKED}) AS r FROM it),
slots AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY project_id {_RANKED}) AS r FROM it
  WHERE kind IN ('task', 'next_action') AND status IN {_OPEN}) x WHERE r <= 5),
sel AS (SELECT * FROM (SELECT p.*, count(*) OVER (PARTITION BY project_id) AS total,
   row_number() OVER (PARTITION BY project_id ORDER BY s.item_id IS NULL, r) AS rank
  FROM placed p LEFT JOIN slots s ON s.item_id = p.item_id) y WHERE rank <= 50),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_NEWEST}, record_id) AS recency FROM rec
  WHERE project_id IS NOT NULL AND provider <> 'project_document') x WHERE recency <= 60),
ins AS (SELECT * FROM (SELECT rec.*, row_number() OVER (PARTITION BY project_id ORDER BY {_NEWEST}, record_id) AS nth FROM rec
  JOIN cur USING (record_id) WHERE actor = 'user' AND project_id IS NOT NULL) x WHERE nth = 1),
moved AS (SELECT 'p' || event_id % 7 AS project_id, 'x' || event_id || '-2' AS record_id, CAST(ts AS TIMESTAMP) AS moved_at FROM events WHERE event_id % 10 = 0),
codes AS (SELECT DISTINCT event_id % 10 AS code FROM events WHERE event_id % 10 <> 0),
facet_rows AS (SELECT project_id, 'pending' AS facet, least(rows, 5) AS rows FROM ({_facet('documented_pending')}) a
  UNION ALL SELECT project_id, 'claims', least(rows, 7) FROM ({_facet('documented_claim')}) b),
doc AS (SELECT project_id, count(*) FILTER (category = 'documented_pending' AND source_current) AS pending,
  count(*) FILTER (category = 'documented_claim') AS claims, count(*) FILTER (vanished) AS vanished
  FROM it WHERE provider = 'project_document' GROUP BY 1),
topics AS (SELECT project_id, text FROM it WHERE provider = 'project_document' AND source_current GROUP BY 1, 2 HAVING count(DISTINCT category) = 2),
doubts AS (SELECT project_id, text FROM topics UNION ALL SELECT project_id, 'beside' FROM doc WHERE pending > 0 AND claims > 0
  UNION ALL SELECT project_id, 'vanished' FROM doc WHERE vanished > 0
  UNION ALL SELECT project_id, 'procedure' FROM ins WHERE text LIKE '%replace%'
  UNION ALL SELECT DISTINCT trees.project_id, 'code' || code FROM trees, codes),
acts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY kind <> 'next_action', rank) AS place FROM sel
  WHERE kind IN ('next_action', 'task') AND status IN {_OPEN}) x WHERE place <= 5),
counted AS (SELECT t.project_id, coalesce(f.rows, 0) AS pending,
  (SELECT count(*) FROM acts a WHERE a.project_id = t.project_id AND (f.rows IS NULL OR a.category <> 'documented_pending')) AS rest,
  f.rows IS NOT NULL AND EXISTS (SELECT 1 FROM ins i WHERE i.project_id = t.project_id AND i.text LIKE '%replace%')
   AND EXISTS (SELECT 1 FROM doubts d WHERE d.project_id = t.project_id) AS changed
  FROM (SELECT DISTINCT project_id FROM trees) t LEFT JOIN facet_rows f ON f.project_id = t.project_id AND f.facet = 'pending'),
newest AS (SELECT project_id, worktree_id, arg_min(revision, recency) AS newest FROM win WHERE revision IS NOT NULL GROUP BY 1, 2),
checks AS (SELECT w.project_id FROM win w LEFT JOIN newest m USING (project_id, worktree_id) LEFT JOIN trees t ON t.worktree_id = w.worktree_id
  WHERE w.kind = 'recorded_tool_result' AND (revision IS NULL OR newest <> revision OR (number % 2 = 0 AND revision <> 'rev1'))),
gaps AS (SELECT DISTINCT project_id, source_id FROM rec JOIN gen USING (generation_id) JOIN src USING (source_id) WHERE src.status <> 'ready'),
uncertain AS (SELECT project_id FROM win WHERE time_status <> 'known' UNION ALL SELECT project_id FROM win WHERE event_type IS NOT NULL
  UNION ALL SELECT project_id FROM win WHERE text LIKE '%unclear%' UNION ALL SELECT project_id FROM checks
  UNION ALL SELECT project_id FROM sel WHERE category = 'agent_claim' UNION ALL SELECT project_id FROM gaps),
stop AS (SELECT coalesce(s.project_id, m.project_id) AS project_id,
  CASE WHEN m.moved_at IS NOT NULL AND (s.event_time IS NULL OR m.moved_at >= s.event_time) THEN m.record_id ELSE s.record_id END AS detail
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY recency) AS nth FROM win WHERE actor IN ('user', 'assistant')) x WHERE nth = 1) s
 FULL JOIN (SELECT project_id, arg_max(record_id, row(moved_at, record_id)) AS record_id, max(moved_at) AS moved_at FROM moved GROUP BY 1) m ON m.project_id = s.project_id),
every AS (
 SELECT 'project' AS relation, project_id, count(*) AS rows, CAST(count(*) FILTER (number % 2 = 0) AS VARCHAR) AS detail FROM trees GROUP BY 2
 UNION ALL SELECT 'sessions', project_id, least(20, count(DISTINCT session_id)), '-' FROM rec GROUP BY 2
 UNION ALL SELECT 'items', project_id, count(*), CAST(max(total) AS VARCHAR) FROM sel GROUP BY 2
 UNION ALL SELECT 'unfinished', project_id, count(*), '-' FROM sel WHERE kind IN ('task', 'next_action') AND status IN {_OPEN} GROUP BY 2
 UNION ALL SELECT 'decisions', project_id, count(*), '-' FROM sel WHERE kind = 'decision' AND status = 'accepted' GROUP BY 2
 UNION ALL SELECT 'claims', project_id, count(*), '-' FROM sel WHERE kind = 'claim' GROUP BY 2
 UNION ALL SELECT 'objective', project_id, 1, arg_max(record_id, row(event_time IS NOT NULL, coalesce(event_time, TIMESTAMP '1970-01-01'), item_id)) FROM it
   WHERE kind = 'objective' AND status = 'active' GROUP BY 2
 UNION ALL SELECT 'next_actions', project_id, least(5, CASE WHEN changed THEN 1 + pending ELSE pending + rest END), '-' FROM counted WHERE changed OR pending + rest > 0
 UNION ALL SELECT 'latest_instruction', project_id, 1, record_id FROM ins
 UNION ALL SELECT 'stopping_point', project_id, 1, detail FROM stop
 UNION ALL SELECT 'agent_updates', w.project_id, least(3, count(*)), '-' FROM win w LEFT JOIN ins i ON i.project_id = w.project_id
   WHERE w.actor = 'assistant' AND (i.project_id IS NULL OR coalesce(w.event_time, TIMESTAMP '0001-01-01') >= coalesce(i.event_time, TIMESTAMP '0001-01-01')) GROUP BY 2
 UNION ALL SELECT 'recent_results', project_id, least(3, count(*)), '-' FROM win WHERE kind = 'recorded_tool_result' GROUP BY 2
 UNION ALL SELECT 'facts', project_id, count(*), '-' FROM win WHERE revision IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'evidence', project_id, count(*), '-' FROM win WHERE kind = 'recorded_tool_result' GROUP BY 2
 UNION ALL SELECT 'uncertainties', project_id, count(*), '-' FROM uncertain GROUP BY 2
 UNION ALL SELECT 'facets', project_id, CAST(sum(rows) AS BIGINT), '-' FROM facet_rows GROUP BY 2
 UNION ALL SELECT 'facet_omissions', project_id, 1, '-' FROM doc
 UNION ALL SELECT 'conflicts', project_id, count(*), '-' FROM doubts GROUP BY 2
 UNION ALL SELECT 'principles', project_id, count(*), '-' FROM rec WHERE n % 6 = 3 AND n % 4 = 1 GROUP BY 2
 UNION ALL SELECT 'mappings', project_id, least(20, count(*)), '-' FROM rec WHERE n % 6 = 1 GROUP BY 2
 UNION ALL SELECT 'identity', project_id, 2 * count(*), '-' FROM moved GROUP BY 2
 UNION ALL SELECT 'notices', project_id, CAST(count(DISTINCT code) AS BIGINT), '-' FROM (SELECT project_id, 'gone' AS code FROM trees WHERE NOT active
   UNION ALL SELECT project_id, 'omitted' FROM sel WHERE total > 50 UNION ALL SELECT project_id, 'coverage' FROM trees) x GROUP BY 2
 UNION ALL SELECT 'coverage', '-', 1, concat_ws(' ', (SELECT count(*) FROM src), (SELECT count(*) FROM src WHERE status <> 'ready'),
   (SELECT count(*) FROM rec WHERE project_id IS NULL AND text <> ''), (SELECT count(*) FROM rec WHERE time_status <> 'known' AND provider <> 'project_document'), 'partial'))
SELECT relation, project_id, rows::BIGINT AS rows, detail FROM every WHERE project_id IS NOT NULL
"""

def _details() -> dict[str, Column]:
    """What a relation's detail column tells beside its number of rows."""
    covered = F.concat_ws(" ", "sources", "sources_not_ready", "unassociated_records", "unknown_event_times", "coverage_status")
    return {
        "project": F.count("head").cast("string"), "items": F.max("total").cast("string"), "objective": F.max("record_id"),
        "latest_instruction": F.max("record_id"), "stopping_point": F.max("record_id"), "coverage": F.max(covered),
    }


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    records = E.derived(spark, sf_dir, _RECORDS).withColumn("session_native_id", F.col("session_id"))
    said = spark.sql(_SAID, records=E.derived(spark, sf_dir, _RECORDS))
    null = F.lit(None).cast("string")
    trees = E.derived(spark, sf_dir, _TREES)
    verdicts = moves.reconcile_moves(*_move_tables(spark, sf_dir)).withColumn(
        "project_id", F.when(F.col("project_id").isNotNull(), F.concat(F.lit("p"), (F.substring("worktree_id", 2, 20).cast("long") % 7).cast("string")))
    )
    # Every second worktree was last seen as the project's own repository, the others as another one.
    own = F.when(F.col("number") % 2 == 0, "c").otherwise("elsewhere")
    given = {
        "path": F.lit("/w"), "common_identity": own, "worktree_identity": F.col("worktree_id"), "branch": F.lit("main"),
        "head": F.lit("rev1"), "available": F.lit(True),
    }
    data = F.struct(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in next(f.dataType for f in schema.fields(schema.OBSERVATIONS) if f.name == "data").fields
    ])
    return {
        "records": records.drop("n", "item_id", "generation_id", "at"),
        "items": said.select(
            "item_id", "record_id", F.lit(0).alias("item_no"), F.col("item_kind").alias("kind"), "text",
            F.col("item_status").alias("status"), "category", null.alias("target"), null.alias("rationale"), null.alias("priority"),
            F.array().cast("array<string>").alias("dependencies"), F.lit("explicit-v1").alias("method"),
            "session_id", "native_id", "provider", "actor", "event_time", "time_status", "project_id", "worktree_id",
        ),
        "projects": trees.select("project_id", F.col("project_id").alias("name"), F.lit("c").alias("common_identity")).distinct(),
        "worktrees": trees.drop("number"),
        "observations": trees.select(
            F.col("number").cast("long").alias("observation_id"), "project_id", "worktree_id",
            F.timestamp_seconds("number").alias("observed_at"), data.alias("data"),
        ),
        "occurrences": records.select("record_id", "generation_id", F.lit("line:1").alias("locator"), F.col("n").alias("position")),
        "generations": E.derived(spark, sf_dir, E.GENERATIONS), "sources": E.derived(spark, sf_dir, E.SOURCES),
        "corrections": E.derived(spark, sf_dir, E.CORRECTIONS).filter("false"),
        "associations": records.filter("n % 6 = 1").select(
            F.concat(F.lit("a"), "record_id").alias("association_id"), F.col("record_id").alias("target"), "project_id", "worktree_id",
            F.lit("chosen").alias("reason"), F.col("at").alias("created_at"),
        ),
        "memory": records.filter("n % 6 = 3").select(
            F.concat(F.lit("m"), "record_id").alias("memory_id"), F.lit("principle").alias("kind"), "text",
            F.when(F.col("n") % 4 == 1, "accepted").otherwise("proposed").alias("status"), F.lit("explicit").alias("origin"),
            F.col("project_id").alias("scope"), F.array().cast("array<string>").alias("refs"), null.alias("reason"),
            F.col("at").alias("created_at"), F.col("at").alias("updated_at"), *[null.alias(c) for c in ("supersedes", "exceptions", "conflicts")],
        ),
        "refresh_runs": records.agg(F.max("n").alias("run_id"), F.lit("partial").alias("status")),
        "verdicts": verdicts,
    }


@query(SQL)
def resume_relations(spark, sf_dir):
    """Rows of every relation of every project's resume, with ids where a relation has one row."""
    out, details = None, _details()
    for name, rows in resume.resume_all(_tables(spark, sf_dir)).items():
        if name == "coverage":
            rows = rows.withColumn("project_id", F.lit("-"))
        elif name == "principles":
            rows = rows.withColumnRenamed("scope", "project_id")
        counted = rows.filter("project_id is not null").groupBy(F.lit(name).alias("relation"), "project_id").agg(
            F.count(F.lit(1)).alias("rows"), details.get(name, F.lit("-")).alias("detail")
        )
        counted = session.stage(counted, f"resume-{name}")  # one plan of all relations would be planned anew after each of its stages
        out = counted if out is None else out.unionByName(counted)
    return out
