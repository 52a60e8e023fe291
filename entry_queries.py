"""Registered queries: each pairs a Spark job with SQL for the check engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import entry_tables as E
from worklore import session
from worklore.functions.plans import settle
from worklore.functions import hashing, jsonops, ordering, patterns as P, textops
from worklore.operators import (
    associate, docs, evidence, extract, facets, identity, moves, normalize, pack, prose, resolve, search,
)
from worklore.plans import context, daily, retention, views
from worklore.sources import chatstore, manifest, sinks, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
ZONE = "America/New_York"
FIRST, LAST = "2024-01-10", "2024-01-12"


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            CHECKS[fn.__name__] = sql
        return fn

    return add


# --- SQL building blocks ------------------------------------------------------------

T = E.for_check(E.TRANSCRIPTS)
I = E.for_check(E.ITEMS)
OCC = E.for_check(E.OCCURRENCES)
GEN = E.for_check(E.GENERATIONS)
SRC = E.for_check(E.SOURCES)
COR = E.for_check(E.CORRECTIONS)
ACT = E.for_check(E.ACTIVITY)
LOWER = f"timezone('UTC', timezone('{ZONE}', TIMESTAMP '{FIRST} 00:00:00'))"
UPPER = f"timezone('UTC', timezone('{ZONE}', TIMESTAMP '2024-01-13 00:00:00'))"
CURRENT = f"SELECT DISTINCT record_id FROM ({OCC}) o JOIN ({GEN}) g USING (generation_id) WHERE g.status = 'current'"
VIEW = f"""SELECT i.*, c.record_id IS NOT NULL AS source_current
 FROM ({I}) i LEFT JOIN ({CURRENT}) c ON c.record_id = i.record_id"""
RESOLVED_CTE = f"""
 WITH v AS ({VIEW}),
 actions AS (SELECT * FROM v WHERE kind = 'correction' AND target IS NOT NULL AND source_current),
 named AS (SELECT DISTINCT item_id, record_id, project_id, worktree_id, event_time, nm FROM (
   SELECT *, item_id AS nm FROM v UNION ALL SELECT *, record_id AS nm FROM v UNION ALL SELECT *, native_id AS nm FROM v) x
   WHERE kind <> 'correction'),
 pairs AS (SELECT a.item_id AS action_id, a.record_id AS action_record_id, a.actor, a.event_time AS acted, a.status AS new_status,
          n.item_id, n.record_id FROM actions a JOIN named n ON n.nm = a.target
          AND n.project_id IS NOT DISTINCT FROM a.project_id AND n.worktree_id IS NOT DISTINCT FROM a.worktree_id
          AND n.event_time <= a.event_time),
 judged AS (SELECT action_id, count(DISTINCT record_id) AS records FROM pairs GROUP BY action_id),
 applied AS (SELECT p.* FROM pairs p JOIN judged j USING (action_id) WHERE j.records = 1 AND p.actor = 'user'),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY acted DESC, action_id DESC) AS rn,
             count(*) OVER (PARTITION BY item_id) AS hits FROM applied),
 c AS ({COR}),
 over_all AS (SELECT i.item_id, c.* FROM v i JOIN c ON c.target = i.item_id OR c.target = i.record_id),
 over_status AS (SELECT item_id, status, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, correction_id DESC) AS rn
                 FROM over_all WHERE status IS NOT NULL),
 over_text AS (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, correction_id DESC) AS rn
               FROM over_all WHERE text IS NOT NULL),
 over_count AS (SELECT item_id, count(*) AS n FROM over_all GROUP BY item_id),
 resolved AS (SELECT v.item_id, v.record_id, v.kind, v.project_id, v.worktree_id, v.provider, v.actor, v.category, v.event_time,
   v.priority, v.source_current,
   COALESCE(t.text, v.text) AS text,
   COALESCE(s.status, o.new_status, CASE WHEN NOT v.source_current AND v.status IN ('active','blocked','pending','proposed')
            THEN 'source_superseded' ELSE v.status END) AS status,
   CASE WHEN NOT v.source_current AND v.status IN ('active','blocked','pending','proposed') THEN v.status END AS historical_status,
   COALESCE(o.hits, 0) + COALESCE(n.n, 0) AS resolutions,
   CASE WHEN a.item_id IS NOT NULL AND ap.action_id IS NULL THEN 1 ELSE 0 END AS uncertain
  FROM v LEFT JOIN (SELECT * FROM ordered WHERE rn = 1) o ON o.item_id = v.item_id
  LEFT JOIN (SELECT * FROM over_status WHERE rn = 1) s ON s.item_id = v.item_id
  LEFT JOIN (SELECT * FROM over_text WHERE rn = 1) t ON t.item_id = v.item_id
  LEFT JOIN over_count n ON n.item_id = v.item_id
  LEFT JOIN actions a ON a.item_id = v.item_id
  LEFT JOIN (SELECT DISTINCT action_id FROM applied) ap ON ap.action_id = v.item_id)
"""
IMPORTANCE = """CASE WHEN status IN ('active','pending','blocked') THEN
  CASE kind WHEN 'blocker' THEN 0 WHEN 'next_action' THEN 1 WHEN 'task' THEN 2 WHEN 'decision' THEN 3 ELSE 4 END ELSE 5 END"""


# --- scans, context carry, identity -----------------------------------------------------


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no,
 COALESCE(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 ::BIGINT AS byte_offset FROM conversations""")
def line_numbers(spark, sf_dir):
    rows = E.table(spark, sf_dir, "conversations").withColumn("block", F.floor(F.col("turn") / 3))
    return ordering.number_rows(
        rows, ["conv_id"], "block", "turn", "line_no",
        weight=(F.octet_length("text") + 1).cast("long"), offset="byte_offset",
    ).select("conv_id", "turn", "line_no", F.col("byte_offset").cast("long").alias("byte_offset"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
 OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn
 FROM conversations QUALIFY last_user_turn IS NOT NULL""")
def context_carry(spark, sf_dir):
    rows = E.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.floor(F.col("turn") / 2).alias("block"),
        F.when(F.col("role") == "user", F.col("turn")).alias("last_user_turn"),
    )
    return ordering.carry_forward(rows, ["conv_id"], "block", "turn", ["last_user_turn"]).filter(
        "last_user_turn is not null"
    ).select("conv_id", "turn", "last_user_turn")


def _framed(*cols: str) -> str:
    parts = [f"COALESCE(length(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')" for c in cols]
    return "sha256(" + " || ".join(parts) + ")"


@query(f"SELECT doc_id, {_framed('source', 'lang', 'text')} AS content_id FROM documents")
def content_identity(spark, sf_dir):
    return E.spread(spark, sf_dir, "documents").select(
        "doc_id", hashing.content_id(F.col("source"), F.col("lang"), F.col("text")).alias("content_id")
    )


@query(f"""SELECT {_framed('lang', 'text')} AS record_id, count(*) AS copies, min(doc_id) AS first_doc
 FROM documents GROUP BY 1""")
def record_copies(spark, sf_dir):
    return E.spread(spark, sf_dir, "documents").select(
        "doc_id", hashing.content_id(F.col("lang"), F.col("text")).alias("record_id")
    ).groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(f"""SELECT DISTINCT {_framed('lang', 'text')} AS record_id, length(text) AS chars FROM documents""")
def distinct_records(spark, sf_dir):
    rows = E.spread(spark, sf_dir, "documents").select(
        hashing.content_id(F.col("lang"), F.col("text")).alias("record_id"), F.length("text").cast("long").alias("chars")
    )
    return identity.distinct_records(rows, ["record_id", "chars"])


@query(f"""SELECT DISTINCT {_framed('provider', 'session_id')} AS session_id, provider, session_id AS native_id FROM ({T}) t""")
def session_dimension(spark, sf_dir):
    return identity.sessions_of(E.records(spark, sf_dir))


@query(f"""SELECT generation_id, source_id, CASE WHEN number = max(number) OVER (PARTITION BY source_id)
 THEN 'current' ELSE 'superseded' END AS status FROM ({GEN}) g""")
def generation_states(spark, sf_dir):
    return identity.generation_status(E.derived(spark, sf_dir, E.GENERATIONS)).select(
        "generation_id", "source_id", "status"
    )


@query(f"""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY role, content ORDER BY active DESC, id DESC) AS rn
 FROM (SELECT conv_id * 1000 + turn AS id, role, text AS content, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS active
  FROM conversations) m) r WHERE rn = 1""")
def compaction_copies(spark, sf_dir):
    """Among equal visible chat rows, the highest active one, then the highest id."""
    c = E.table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    messages = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("s").alias("session_id"), "role",
        F.col("text").alias("content"), F.lit(0.0).alias("timestamp"), null.alias("tool_call_id"),
        null.alias("tool_calls"), null.alias("tool_name"),
        F.when(F.col("turn") % 2 == 0, 1).otherwise(0).alias("active"), F.lit(1).alias("compacted"),
    )
    return identity.without_copies(messages).select("id")


@query(f"""SELECT t.provider, count(*) AS records FROM ({T}) t
 WHERE NOT EXISTS (SELECT 1 FROM ({COR}) c JOIN ({T}) x ON x.record_id = c.target WHERE x.provider = t.provider AND x.session_id = t.session_id)
 GROUP BY 1""")
def tombstone_filter(spark, sf_dir):
    """Records whose session holds no corrected record, counted per provider."""
    records = E.records(spark, sf_dir)
    targets = E.derived(spark, sf_dir, E.CORRECTIONS).select(F.col("target").alias("record_id"))
    gone = records.join(targets, "record_id", "left_semi").select("provider", "session_native_id")
    return identity.without_forgotten(records, gone).groupBy("provider").agg(F.count(F.lit(1)).alias("records"))


# --- envelopes ------------------------------------------------------------------------------


def _lines(df: DataFrame, value) -> DataFrame:
    return settle(df.select(
        F.col("session_id").alias("source_path"), F.floor(F.col("line_no") / 50).alias("block"), "line_no",
        F.concat(F.lit("line:"), F.col("line_no").cast("string")).alias("locator"),
        value.alias("value"), F.lit(False).alias("tail"),
    ))


def rollout_lines(spark, sf_dir) -> DataFrame:
    """The transcripts as rollout files, one per session with its header line."""
    t = E.spread_records(spark, sf_dir).withColumn("line_no", F.substring("record_id", 2, 20).cast("long") + 1)
    at = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    part = F.struct(
        F.when(F.col("actor") == "user", "input_text").otherwise("output_text").alias("type"), F.col("text").alias("text")
    )
    body = F.to_json(F.struct(
        at.alias("timestamp"), F.lit("response_item").alias("type"),
        F.struct(F.lit("message").alias("type"), F.col("record_id").alias("id"), F.col("actor").alias("role"),
                 F.array(part).alias("content")).alias("payload"),
    ))
    heads = t.select("session_id").distinct().withColumn("line_no", F.lit(0).cast("long"))
    head = F.to_json(F.struct(
        F.lit("session_meta").alias("type"),
        F.struct(F.col("session_id").alias("id"), F.concat(F.lit("/w/"), F.col("session_id")).alias("cwd")).alias("payload"),
    ))
    return _lines(t, body).unionByName(_lines(heads, head))


def message_lines(spark, sf_dir) -> DataFrame:
    t = E.spread_records(spark, sf_dir).withColumn("line_no", F.substring("record_id", 2, 20).cast("long") + 1)
    at = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(
        F.col("actor").alias("type"), F.col("session_id").alias("sessionId"), F.col("record_id").alias("uuid"),
        F.concat(F.lit("/w/"), F.col("session_id")).alias("cwd"), at.alias("timestamp"),
        F.struct(F.col("actor").alias("role"),
                 F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message"),
    ))
    return _lines(t, body)


def _normalized(events: DataFrame) -> DataFrame:
    return normalize.records_of(events).select(
        "provider", F.col("session_native_id").alias("session_native"), "native_id", "actor", "kind", "text", "cwd",
        "time_status", F.coalesce(F.unix_micros("event_time"), F.lit(0)).alias("event_us"),
    )


_TIME = """CASE WHEN event_time IS NULL THEN 'missing' ELSE 'known' END AS time_status, COALESCE(epoch_us(event_time), 0) AS event_us"""


@query(f"""SELECT 'codex' AS provider, session_id AS session_native, record_id AS native_id, actor, kind, text,
 '/w/' || session_id AS cwd, {_TIME} FROM ({T}) t
 UNION ALL SELECT DISTINCT 'codex', session_id, 'line:0', 'system', 'metadata', '', '/w/' || session_id, 'missing', 0 FROM ({T}) t""")
def rollout_envelopes(spark, sf_dir):
    return _normalized(normalize.normalize_rollout(transcripts.parse_lines(rollout_lines(spark, sf_dir))))


@query(f"""SELECT 'claude' AS provider, session_id AS session_native, record_id || ':block:0' AS native_id, actor, kind, text,
 '/w/' || session_id AS cwd, {_TIME} FROM ({T}) t""")
def message_envelopes(spark, sf_dir):
    return _normalized(normalize.normalize_messages(transcripts.parse_lines(message_lines(spark, sf_dir))))


@query("""SELECT CASE role WHEN 'user' THEN 'user_intent' WHEN 'assistant' THEN 'agent_claim' ELSE 'metadata' END AS kind,
 role AS actor, CAST(conv_id * 1000 + turn + 1 AS VARCHAR) AS native_id, CAST(conv_id AS VARCHAR) AS session_native, text AS full_text
 FROM conversations""")
def chat_rows(spark, sf_dir):
    c = E.table(spark, sf_dir, "conversations")
    messages = c.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role",
        F.col("text").alias("content"), (F.lit(1700000000.0) + F.col("turn")).alias("timestamp"),
    )
    sessions = c.select(F.col("conv_id").cast("string").alias("id")).distinct().withColumn("started_at", F.lit(0.0))
    events = normalize.normalize_chat(chatstore.read_message_store(sessions, messages))
    return events.filter("record is not null").select(
        "record.kind", "record.actor", "record.native_id",
        F.col("record.session_native_id").alias("session_native"), "record.full_text",
    )


# The check engine's regex has no (?!); the boundaries below are plain classes.
_SECRET = r'token = "[0-9a-f]{40}"'
_MAIL = r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+"
_ADDRESS = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


@query(f"""SELECT doc_id, CASE WHEN length(t) > 4096 THEN substring(t, 1, 4082) || ' …[truncated]' ELSE t END AS text FROM (
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g'),
  '{_SECRET}', '[REDACTED]', 'g'), '{_MAIL}', '[REDACTED]', 'g'), '{_ADDRESS}', '[REDACTED]', 'g') AS t FROM documents) r""")
def redaction(spark, sf_dir):
    return E.spread(spark, sf_dir, "documents").select(
        "doc_id", textops.redact(F.col("text"), extra_patterns=(_SECRET, _MAIL, _ADDRESS)).alias("text")
    )


# --- association and evidence -----------------------------------------------------------------

_PAGE_PATHS = r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/$', '') AS cwd FROM {pages}"
_TREES = f"""SELECT concat('w', path) AS worktree_id, concat('p', path) AS project_id, path FROM (
 SELECT DISTINCT concat('/', split_part(cwd, '/', 2)) AS path FROM ({_PAGE_PATHS}) a WHERE cwd <> ''
 UNION SELECT DISTINCT cwd AS path FROM ({_PAGE_PATHS}) b WHERE length(cwd) > 5) paths WHERE path <> '/'"""


@query(f"""WITH pg AS ({_PAGE_PATHS.format(pages='pages')}), tr AS ({_TREES.format(pages='pages')}),
 hit AS (SELECT page_id, worktree_id, row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC) AS rn
  FROM pg JOIN tr ON pg.cwd = tr.path OR starts_with(pg.cwd, tr.path || '/') )
 SELECT pg.page_id, COALESCE(worktree_id, '-') AS worktree_id,
  CASE WHEN worktree_id IS NOT NULL THEN 'recorded_cwd_registered_worktree' WHEN pg.cwd = '' THEN 'missing_working_context'
   ELSE 'unregistered_working_context' END AS association_reason
 FROM pg LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON h.page_id = pg.page_id""")
def directory_association(spark, sf_dir):
    pages = E.derived(spark, sf_dir, _PAGE_PATHS, "pages")
    trees = E.derived(spark, sf_dir, _TREES, "pages")
    return associate.associate(pages, trees).select(
        "page_id", F.coalesce("worktree_id", F.lit("-")).alias("worktree_id"), "association_reason"
    )


_MAPPINGS = f"""SELECT concat('m', CAST(event_id AS STRING)) AS association_id,
 CASE WHEN k % 2 = 0 THEN concat('r', CAST(event_id + k AS STRING)) ELSE concat('s', CAST(user_id AS STRING)) END AS target,
 concat('q', CAST(k % 5 AS STRING)) AS project_id, CAST(NULL AS STRING) AS worktree_id, 'asked' AS reason,
 CAST(ts AS TIMESTAMP) AS created_at FROM ({E._KEYED}) keyed WHERE event_type = 'signup' AND value > 8"""
MAP = E.for_check(_MAPPINGS)


@query(f"""WITH m AS ({MAP}), t AS ({T}), hit AS (
 SELECT t.record_id, m.project_id, row_number() OVER (PARTITION BY t.record_id ORDER BY m.created_at DESC, m.association_id DESC) AS rn
 FROM t JOIN m ON m.target = t.record_id OR m.target = t.session_id)
 SELECT t.record_id, COALESCE(h.project_id, '-') AS project_id,
  CASE WHEN h.project_id IS NULL THEN 'unregistered_working_context' ELSE 'explicit_user_mapping' END AS association_reason
 FROM t LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON h.record_id = t.record_id""")
def explicit_mapping(spark, sf_dir):
    records = E.records(spark, sf_dir).withColumn("cwd", F.concat(F.lit("/none/"), F.col("session_id")))
    trees = spark.createDataFrame([], "worktree_id string, project_id string, path string")
    out = associate.associate(records, trees, E.derived(spark, sf_dir, _MAPPINGS))
    return out.select("record_id", F.coalesce("project_id", F.lit("-")).alias("project_id"), "association_reason")


@query(f"""SELECT t.record_id, count(s.source_id) AS places,
 CASE WHEN bool_or(g.status = 'current' AND s.status IN ('ready', 'partial')) THEN 'current' ELSE 'missing_or_superseded' END AS evidence_status,
 min(s.path) AS first_path
 FROM ({T}) t LEFT JOIN ({OCC}) o ON o.record_id = t.record_id LEFT JOIN ({GEN}) g ON g.generation_id = o.generation_id
 LEFT JOIN ({SRC}) s ON s.source_id = g.source_id GROUP BY t.record_id""")
def record_evidence(spark, sf_dir):
    return evidence.evidence(E.records(spark, sf_dir), _located(spark, sf_dir)).select(
        "record_id", F.col("places").cast("long").alias("places"), "evidence_status", "first_path"
    )


def _located(spark, sf_dir):
    return evidence.locations(
        E.derived(spark, sf_dir, E.OCCURRENCES), E.derived(spark, sf_dir, E.GENERATIONS), E.derived(spark, sf_dir, E.SOURCES)
    )


@query(f"""SELECT o.record_id, s.path, g.number AS generation, g.status AS generation_status, s.status AS source_status, o.locator
 FROM ({OCC}) o JOIN ({GEN}) g USING (generation_id) JOIN ({SRC}) s USING (source_id)""")
def evidence_places(spark, sf_dir):
    return _located(spark, sf_dir).select("record_id", "path", "generation", "generation_status", "source_status", "locator")


@query(CURRENT)
def current_records(spark, sf_dir):
    return E.current_ids(spark, sf_dir)


@query(f"""SELECT DISTINCT COALESCE(t.project_id, '-') AS project_id, s.path, s.status AS source_status
 FROM ({T}) t JOIN ({OCC}) o USING (record_id) JOIN ({GEN}) g USING (generation_id) JOIN ({SRC}) s ON s.source_id = g.source_id""")
def project_sources(spark, sf_dir):
    return evidence.project_sources(
        E.records(spark, sf_dir), E.derived(spark, sf_dir, E.OCCURRENCES), E.derived(spark, sf_dir, E.GENERATIONS),
        E.derived(spark, sf_dir, E.SOURCES),
    ).select(F.coalesce("project_id", F.lit("-")).alias("project_id"), "path", "source_status")


@query(f"""SELECT DISTINCT t.session_id FROM ({T}) t JOIN ({OCC}) o USING (record_id) JOIN ({GEN}) g USING (generation_id)
 JOIN ({SRC}) s ON s.source_id = g.source_id WHERE s.path LIKE '/sessions/src1%.jsonl'""")
def excluded_sessions(spark, sf_dir):
    return evidence.sessions_of_sources(
        E.records(spark, sf_dir), E.derived(spark, sf_dir, E.OCCURRENCES), E.derived(spark, sf_dir, E.GENERATIONS),
        E.derived(spark, sf_dir, E.SOURCES), "/sessions/src1*.jsonl",
    )


@query("""SELECT 'c' || o_custkey AS worktree_id, max(o_orderkey) AS observation_id, arg_max(o_orderpriority, o_orderkey) AS head
 FROM orders GROUP BY o_custkey""")
def latest_observation(spark, sf_dir):
    rows = E.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("worktree_id"),
        F.col("o_orderkey").alias("observation_id"), F.col("o_orderdate").alias("observed_at"),
        F.struct(F.col("o_orderpriority").alias("head")).alias("data"),
    )
    return evidence.latest_observations(rows).select("worktree_id", "observation_id", F.col("data.head").alias("head"))


# --- extraction ----------------------------------------------------------------------------------


@query(f"SELECT record_id, item_no, kind, text, status, category, target, priority, method FROM ({I}) i")
def extracted_items(spark, sf_dir):
    return extract.extract_items(E.spread_records(spark, sf_dir)).select(
        "record_id", "item_no", "kind", "text", "status", "category", "target", "priority", "method"
    )


@query(f"""SELECT kind, status, category, count(*) AS items FROM ({I}) i GROUP BY kind, status, category""")
def ingested_items(spark, sf_dir):
    """Raw rollout lines to items in one plan: parse, normalise, redact, identify, extract."""
    events = normalize.normalize_rollout(transcripts.parse_lines(rollout_lines(spark, sf_dir)))
    records = normalize.records_of(events).withColumn("tool", F.col("metadata.tool"))
    return extract.extract_items(records).groupBy("kind", "status", "category").agg(F.count(F.lit(1)).alias("items"))


@query("""SELECT conv_id, turn, array_to_string([x FOR x IN [text, role, 'tail'] IF x <> ''], chr(10)) AS content
 FROM conversations""")
def nested_content(spark, sf_dir):
    """Text of tool results that nest as deep as their turn's number, and deeper."""
    deep = lambda c: F.concat(F.expr("repeat('[', turn + 3)"), F.to_json(F.array(c)), F.expr("repeat(']', turn + 3)"))
    part = F.concat(
        F.lit('[{"type": "tool_result", "content": [{"type": "text", "text": '), F.to_json(F.array(F.coalesce("text", F.lit("")))),
        F.lit('}, {"type": "image", "text": "left out"}, 5, null, {"text": "untyped"}, '), deep(F.col("role")), F.lit(']}, "", "tail"]'),
    )
    rows = settle(E.table(spark, sf_dir, "conversations").select("conv_id", "turn", jsonops.parse(part).alias("value")))
    return rows.select("conv_id", "turn", jsonops.flat_text(F.col("value")).alias("content"))


@query("""SELECT event_type, count(*) AS items, min(item) AS first_text, sum(length(item))::BIGINT AS letters
 FROM (SELECT event_type, concat('Repair probe ', CAST(event_id AS VARCHAR), '.') AS item FROM events) e GROUP BY 1""")
def long_records(spark, sf_dir):
    """Records of up to 3000 statements: none is left out."""
    texts = E.statement_texts(E.table(spark, sf_dir, "events"))
    records = texts.select(
        F.to_json(F.struct("event_type", "block")).alias("record_id"), F.lit("codex").alias("provider"), F.lit("user").alias("actor"),
        F.lit("user_intent").alias("kind"), F.col("text").alias("full_text"), F.lit(None).cast("string").alias("tool"),
    )
    event_type = F.get_json_object("record_id", "$.event_type").alias("event_type")
    return extract.extract_items(records).groupBy(event_type).agg(
        F.count("*").alias("items"), F.min("text").alias("first_text"), F.sum(F.length("text")).cast("long").alias("letters")
    )


@query("""SELECT user_id % 2 AS doc, count(*) AS sections, min(event_id)::VARCHAR AS first_id, sum(length(concat('Body of probe ', event_id, '.')))::BIGINT AS letters
 FROM events GROUP BY 1""")
def long_documents(spark, sf_dir):
    """Documents of up to 6000 sections, for either half of the users: none is left out."""
    texts = E.section_texts(E.table(spark, sf_dir, "events"))
    documents = texts.select(
        "document_id", "text", F.concat("document_id", F.lit(".md")).alias("relative_path"), F.lit("/r").alias("root_path"),
        F.sha2("text", 256).alias("fingerprint"),
    )
    records = docs.section_records(documents, F.lit("2026-01-01").cast("timestamp"))
    body = F.regexp_extract("full_text", r"Body of probe [0-9]+\.", 0)
    number = F.regexp_extract("full_text", r"probe ([0-9]+)\.", 1).cast("bigint")
    doc = F.substring_index("session_native_id", ".", 1).cast("bigint").alias("doc")
    return records.groupBy(doc).agg(
        F.count("*").alias("sections"), F.min(number).cast("string").alias("first_id"), F.sum(F.length(body)).cast("long").alias("letters")
    )


@query(f"SELECT item_id, lower(rtrim(text, '.')) AS topic FROM ({I}) i")
def topic_keys(spark, sf_dir):
    return E.items(spark, sf_dir).select("item_id", textops.topic_key(F.col("text")).alias("topic"))


@query("""SELECT doc_id, pos - 1 AS line_no, trim(line) AS line FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
 WHERE NOT regexp_matches(text, '<!--|```|~~~') AND NOT regexp_matches(text, '(?m)^[ \\t]*>')) l
 WHERE trim(line) <> '' AND NOT starts_with(line, '    ') AND NOT starts_with(line, chr(9)) AND NOT regexp_matches(trim(line), '^["''“‘]')
 AND NOT regexp_matches(line, '^ {0,3}([-*+] |[0-9]+[.)] )')""")
def plain_prose_lines(spark, sf_dir):
    """Prose lines of documents without regions; list lines are left to the fixtures."""
    d = E.spread(spark, sf_dir, "documents").filter(
        ~F.col("text").rlike(r"<!--|```|~~~") & ~F.col("text").rlike(r"(?m)^[ \t]*>")
    ).select(F.col("doc_id").alias("record_id"), F.col("text").alias("full_text"))
    listed = F.col("raw").rlike(r"^ {0,3}([-*+] |[0-9]+[.)] )")
    lines = prose.prose_lines(d)
    raw = d.select("record_id", F.posexplode(F.split("full_text", "\n")).alias("p", "raw")).filter(listed).select(
        F.col("record_id").alias("_r"), F.col("p").alias("_p")
    )
    return lines.join(raw, (F.col("record_id") == F.col("_r")) & (F.col("line_no") == F.col("_p")), "left_anti").select(
        F.col("record_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "line"
    )


@query()
def document_sections(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents")
    return docs.sectionize(d, "doc_id").select(
        "doc_id", "number", "section", "line_start", "line_end", "source_context", "segment_order", "segment_count",
        F.sha2("text", 256).alias("text_hash"),
    )


@query("""SELECT doc_id, sum(length(replace(replace(line, ' ', ''), chr(9), '')))::BIGINT AS letters FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
 WHERE NOT regexp_matches(text, '(?m)^ {0,3}#{1,6}[ \\t]') AND NOT regexp_matches(text, '(?m)^ {0,3}(=+|-+)[ \\t]*$')
   AND NOT contains(text, chr(13))) l GROUP BY doc_id HAVING letters > 0""")
def section_characters(spark, sf_dir):
    """Sections of heading-free documents keep every character that is not blank."""
    d = E.spread(spark, sf_dir, "documents").filter(
        ~F.col("text").rlike(r"(?m)^ {0,3}#{1,6}[ \t]") & ~F.col("text").rlike(r"(?m)^ {0,3}(=+|-+)[ \t]*$")
        & ~F.contains("text", F.lit("\r"))
    )
    letters = F.length(F.regexp_replace("text", r"[ \t\n]", ""))
    return docs.sectionize(d, "doc_id").groupBy("doc_id").agg(F.sum(letters).cast("long").alias("letters")).filter("letters > 0")


# --- resolution and item views ---------------------------------------------------------------------


@query(RESOLVED_CTE + """SELECT item_id, kind, status, text, resolutions::BIGINT AS resolutions, uncertain::BIGINT AS uncertain,
 COALESCE(historical_status, '-') AS historical_status FROM resolved""")
def resolved_items(spark, sf_dir):
    return E.resolved(spark, sf_dir).select(
        "item_id", "kind", "status", "text", F.col("resolutions").cast("long").alias("resolutions"),
        F.col("resolution_uncertainty").isNotNull().cast("long").alias("uncertain"),
        F.coalesce("historical_status", F.lit("-")).alias("historical_status"),
    )


@query(RESOLVED_CTE + """SELECT item_id, 'extracted' AS origin, action_record_id AS ref FROM applied
 UNION ALL SELECT item_id, 'explicit', correction_id FROM over_all""")
def resolution_refs(spark, sf_dir):
    return resolve.resolution_refs(E.view(spark, sf_dir), E.derived(spark, sf_dir, E.CORRECTIONS)).select(
        "item_id", "origin", "ref"
    )


TASKS_SQL = f""", picked AS (SELECT * FROM resolved WHERE kind IN ('task','next_action','blocker','claim','correction')
   AND status NOT IN ('archived','rejected')),
 placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {IMPORTANCE}, event_time DESC NULLS LAST, item_id DESC) AS r,
   count(*) OVER (PARTITION BY project_id) AS total FROM picked),
 slots AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY project_id ORDER BY {IMPORTANCE}, event_time DESC NULLS LAST, item_id DESC) AS r
   FROM picked WHERE kind IN ('task','next_action') AND status IN ('active','pending','blocked')) x WHERE r <= 5),
 final AS (SELECT p.*, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN s.item_id IS NULL THEN 1 ELSE 0 END, r) AS rank
   FROM placed p LEFT JOIN slots s ON s.item_id = p.item_id)
 SELECT COALESCE(project_id, '-') AS project_id, rank, item_id, kind, status, text, total, total - 20 AS omitted
 FROM final WHERE rank <= 20"""


def _task_columns(df):
    return df.select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), F.col("rank").cast("long").alias("rank"),
        "item_id", "kind", "status", "text", "total", F.col("omitted").cast("long").alias("omitted"),
    )


@query(RESOLVED_CTE + TASKS_SQL)
def tasks(spark, sf_dir):
    return _task_columns(views.tasks(E.resolved(spark, sf_dir), 20))


@query(RESOLVED_CTE + """SELECT COALESCE(project_id, '-') AS project_id, rank, item_id, status, text FROM (
 SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY event_time DESC NULLS LAST, item_id DESC) AS rank
 FROM resolved WHERE kind = 'decision' AND status NOT IN ('archived','rejected')) d WHERE rank <= 20""")
def decisions(spark, sf_dir):
    return views.decisions(E.resolved(spark, sf_dir), 20).select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), F.col("rank").cast("long").alias("rank"),
        "item_id", "status", "text",
    )


@query(RESOLVED_CTE + """SELECT item_id, kind, status, text FROM resolved WHERE kind = 'blocker' AND provider = 'claude'
 AND status NOT IN ('archived','rejected') ORDER BY event_time DESC NULLS LAST, item_id DESC LIMIT 50""")
def newest_blockers(spark, sf_dir):
    """Items view with kind and provider filters; corrections still act on it."""
    chosen = resolve.select_items(E.resolved(spark, sf_dir), ["blocker"], "claude")
    return resolve.rank_items(chosen, 50, per=()).select("item_id", "kind", "status", "text")


@query(f"""SELECT COALESCE(project_id, '-') AS project_id, item_id, text FROM (
 SELECT project_id, item_id, text, row_number() OVER (PARTITION BY project_id ORDER BY event_time DESC NULLS LAST, item_id DESC) AS r
 FROM ({I}) i WHERE kind = 'decision') d WHERE r = 1""")
def objective(spark, sf_dir):
    """Newest open objective per project, with the decisions standing in for objectives."""
    v = E.items(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "decision", "objective").otherwise(F.col("kind")))
    return views.objectives(v).select(F.coalesce("project_id", F.lit("-")).alias("project_id"), "item_id", "text")


@query(f"""SELECT COALESCE(project_id, '-') AS project_id, lower(rtrim(text, '.')) AS topic,
 count(*) FILTER (kind = 'task') AS pending, count(*) FILTER (kind = 'next_action') AS claims
 FROM (SELECT i.* REPLACE (CASE kind WHEN 'next_action' THEN replace(text, 'Inspect', 'Repair') ELSE text END AS text) FROM ({VIEW}) i) x
 WHERE source_current AND status NOT IN ('cancelled','superseded','rejected','archived','user_completed')
 GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'task') > 0 AND count(*) FILTER (kind = 'next_action') > 0""")
def topic_conflicts(spark, sf_dir):
    """Topics stated as pending and as done, with next actions standing in for claims."""
    v = E.view(spark, sf_dir).withColumns(
        {
            "text": F.when(F.col("kind") == "next_action", F.replace("text", F.lit("Inspect"), F.lit("Repair"))).otherwise(F.col("text")),
            "category": F.when(F.col("kind") == "task", "documented_pending")
            .when(F.col("kind") == "next_action", "documented_claim").otherwise(F.col("category")),
        }
    )
    return facets.topic_conflicts(v).select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), "topic", "pending", "claims"
    )


@query(RESOLVED_CTE + """SELECT COALESCE(project_id, '-') AS project_id, count(*) AS statements FROM resolved
 WHERE historical_status IN ('active','pending','blocked') GROUP BY project_id""")
def vanished_pending(spark, sf_dir):
    return facets.project_conflicts(E.resolved(spark, sf_dir)).filter("code = 'pending_statements_vanished'").select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), "statements"
    )


# --- daily ----------------------------------------------------------------------------------------


@query(f"""SELECT COALESCE(project_id, '-') AS project_id, provider, actor, session_id, COALESCE(worktree_id, '-') AS worktree_id, count(*) AS records
 FROM ({T}) t WHERE event_time >= {LOWER} AND event_time < {UPPER} GROUP BY 1, 2, 3, 4, 5""")
def daily_actor_groups(spark, sf_dir):
    return daily.actor_groups(E.records(spark, sf_dir), FIRST, LAST, ZONE).withColumns(
        {"project_id": F.coalesce("project_id", F.lit("-")), "worktree_id": F.coalesce("worktree_id", F.lit("-"))}
    )


@query(f"""SELECT COALESCE(project_id, '-') AS project_id, count(*) AS records, count(DISTINCT session_id) AS sessions
 FROM ({T}) t WHERE event_time >= {LOWER} AND event_time < {UPPER} GROUP BY 1""")
def daily_project_totals(spark, sf_dir):
    groups = daily.actor_groups(E.records(spark, sf_dir), FIRST, LAST, ZONE)
    return daily.project_totals(groups).withColumn("project_id", F.coalesce("project_id", F.lit("-")))


DAILY_SQL = f""", bucketed AS (SELECT *, CASE WHEN event_time >= {LOWER} AND event_time < {UPPER} THEN 'activity'
  WHEN kind IN ('task','next_action','blocker') AND status IN ('active','blocked','pending','proposed')
   AND (event_time IS NULL OR event_time < {LOWER}) THEN 'carryover' END AS bucket
  FROM resolved WHERE status NOT IN ('archived','rejected'))"""


@query(RESOLVED_CTE + DAILY_SQL + """SELECT COALESCE(project_id, '-') AS project_id, bucket, rank, item_id, status, total, GREATEST(0, total - 10) AS omitted FROM (
 SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY event_time DESC NULLS LAST, item_id DESC) AS rank,
  count(*) OVER (PARTITION BY project_id, bucket) AS total FROM bucketed WHERE bucket IS NOT NULL) r WHERE rank <= 10""")
def daily_items(spark, sf_dir):
    return daily.ranked_items(E.resolved(spark, sf_dir), FIRST, LAST, ZONE, 10).select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), "bucket", F.col("rank").cast("long").alias("rank"),
        "item_id", "status", "total", F.col("omitted").cast("long").alias("omitted"),
    )


_OBSERVED = """SELECT o_orderkey AS observation_id, concat('p', CAST(o_custkey % 9 AS STRING)) AS project_id,
 concat('w', CAST(o_custkey % 9 AS STRING), '-', CAST(o_custkey AS STRING)) AS worktree_id FROM {orders}"""
OBS = E.for_check(_OBSERVED, "orders")


def _commit_tables(spark, sf_dir):
    """Orders as observations of one worktree per customer, each listing one commit."""
    o = E.table(spark, sf_dir, "orders")
    project = F.concat(F.lit("p"), (F.col("o_custkey") % 9).cast("string"))
    worktree = F.concat(F.lit("w"), (F.col("o_custkey") % 9).cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    at = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 31).cast("int")), "yyyy-MM-dd'T'12:00:00'Z'")
    data = F.struct(
        F.col("o_orderpriority").alias("head"), F.lit(True).alias("available"),
        F.array(F.struct(F.col("o_orderkey").cast("string").alias("revision"), at.alias("committer_time"),
                         F.col("o_orderstatus").alias("subject"))).alias("commits"),
    )
    observations = o.select(
        F.col("o_orderkey").alias("observation_id"), project.alias("project_id"), worktree.alias("worktree_id"),
        F.col("o_orderdate").alias("observed_at"), data.alias("data"),
    )
    worktrees = o.select(worktree.alias("worktree_id"), project.alias("project_id")).distinct()
    projects = o.select(project.alias("project_id")).distinct().withColumn("name", F.concat(F.lit("Project "), F.col("project_id")))
    return observations, worktrees, projects


COMMITS_SQL = f"""SELECT project_id, worktree_id, CAST(observation_id AS VARCHAR) AS revision FROM (
 SELECT *, row_number() OVER (PARTITION BY worktree_id ORDER BY observation_id DESC) AS rn FROM ({OBS}) o) n
 WHERE rn = 1 AND (observation_id % 31) BETWEEN 9 AND 11"""


@query(COMMITS_SQL)
def daily_commits(spark, sf_dir):
    observations, worktrees, _ = _commit_tables(spark, sf_dir)
    return daily.commits(observations, worktrees, FIRST, LAST, ZONE).select("project_id", "worktree_id", "revision")


@query(RESOLVED_CTE + DAILY_SQL + f""", tot AS (SELECT project_id, count(*) AS records, count(DISTINCT session_id) AS sessions FROM ({T}) t
  WHERE event_time >= {LOWER} AND event_time < {UPPER} GROUP BY project_id),
 com AS (SELECT project_id, count(*) AS commits FROM ({COMMITS_SQL}) c GROUP BY project_id),
 seen AS (SELECT COALESCE(t.project_id, c.project_id) AS project_id, COALESCE(records, 0) AS records, COALESCE(sessions, 0) AS sessions,
   COALESCE(commits, 0) AS commits FROM tot t FULL OUTER JOIN com c ON c.project_id = t.project_id),
 cnt AS (SELECT project_id, count(*) FILTER (bucket = 'activity') AS activity, count(*) FILTER (bucket = 'carryover') AS carryover
   FROM bucketed GROUP BY project_id)
 SELECT COALESCE(s.project_id, '-') AS project_id, COALESCE('Project ' || n.project_id, 'Unassociated activity') AS name,
  records, sessions, commits, COALESCE(activity, 0) AS activity, COALESCE(carryover, 0) AS carryover,
  GREATEST(0, COALESCE(activity, 0) - 10) AS activity_omitted, GREATEST(0, COALESCE(carryover, 0) - 10) AS carryover_omitted
 FROM seen s LEFT JOIN cnt ON cnt.project_id IS NOT DISTINCT FROM s.project_id
 LEFT JOIN (SELECT DISTINCT project_id FROM ({OBS}) o) n ON n.project_id = s.project_id""")
def daily_projects(spark, sf_dir):
    observations, worktrees, projects = _commit_tables(spark, sf_dir)
    out = daily.project_days(
        E.records(spark, sf_dir), E.resolved(spark, sf_dir), projects, observations, worktrees, FIRST, LAST, ZONE, 10
    )
    return out.drop("sort_name").withColumn("project_id", F.coalesce("project_id", F.lit("-")))


@query(f"""SELECT CAST(d.day AS VARCHAR) AS day, count(t.record_id) AS records FROM
 (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-18', INTERVAL 1 DAY))::DATE AS day) d
 LEFT JOIN ({T}) t ON timezone('{ZONE}', timezone('UTC', t.event_time))::DATE = d.day GROUP BY d.day""")
def day_spine(spark, sf_dir):
    return daily.day_spine(E.records(spark, sf_dir), "2024-01-18", 14, ZONE).withColumn("day", F.col("day").cast("string"))


# --- views -----------------------------------------------------------------------------------------


@query(f"SELECT status, count(*) AS sources FROM ({SRC}) s GROUP BY status")
def source_states(spark, sf_dir):
    return views.source_counts(E.derived(spark, sf_dir, E.SOURCES))


@query(f"SELECT source_id, status FROM ({SRC}) s ORDER BY (status = 'ready'), provider, path LIMIT 10")
def source_page(spark, sf_dir):
    return views.source_list(E.derived(spark, sf_dir, E.SOURCES), 10).select("source_id", "status")


@query(f"""SELECT count(*) FILTER (project_id IS NULL AND text <> '') AS unassociated_records,
 count(*) FILTER (time_status <> 'known') AS unknown_event_times FROM ({T}) t""")
def record_gaps(spark, sf_dir):
    return views.record_gaps(E.records(spark, sf_dir))


@query("""SELECT l_returnflag || ': ' || l_linestatus AS note, count(*) AS occurrences FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 8""")
def diagnostic_histogram(spark, sf_dir):
    rows = E.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("message"))
    return views.diagnostic_histogram(rows)


@query(f"""SELECT project_id, session_id, records, rank, COALESCE(epoch_us(last_event), 0) AS last_us FROM (SELECT *, row_number() OVER
 (PARTITION BY project_id ORDER BY last_event DESC NULLS LAST, session_id) AS rank FROM (
 SELECT project_id, session_id, count(*) AS records, max(event_time) AS last_event FROM ({T}) t WHERE project_id IS NOT NULL
 GROUP BY project_id, session_id) s) r WHERE rank <= 20""")
def recent_sessions(spark, sf_dir):
    return views.recent_sessions(E.records(spark, sf_dir)).select(
        "project_id", "session_id", "records", F.col("rank").cast("long").alias("rank"),
        F.coalesce(F.unix_micros("last_event"), F.lit(0)).alias("last_us"),
    )


@query("""SELECT 's' || CAST(c_custkey AS VARCHAR) AS session_id, count(o_orderkey) AS records FROM customer LEFT JOIN orders ON o_custkey = c_custkey
 WHERE 's' || CAST(c_custkey AS VARCHAR) < 's5' GROUP BY c_custkey ORDER BY session_id DESC LIMIT 51""")
def session_page(spark, sf_dir):
    """Keyset page over customers as sessions and orders as their records."""
    sid = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("session_id")
    sessions = E.table(spark, sf_dir, "customer").select(sid("c_custkey"))
    records = E.table(spark, sf_dir, "orders").select(sid("o_custkey"), F.col("o_orderdate").alias("event_time"))
    return views.session_page(sessions, records, 50, before="s5").select("session_id", "records")


@query("""SELECT 's' || CAST(o_custkey AS VARCHAR) AS session_id, count(*) AS records, max(epoch_us(o_orderdate)) AS last_us FROM orders
 GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '1998-06-01' AND count(*) FILTER (o_orderstatus = 'X') = 0""")
def retention_candidates(spark, sf_dir):
    records = E.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.when(F.col("o_orderstatus") == "X", "naive").otherwise("known").alias("time_status"),
    )
    return retention.retention_candidates(records, "1998-06-01", "UTC").select(
        "session_id", "records", F.unix_micros("last_event").alias("last_us")
    )


@query(f"""WITH gone AS (SELECT session_id FROM ({T}) t GROUP BY session_id HAVING count(*) FILTER (actor = 'assistant') > count(*) / 4)
 SELECT 'records' AS entity, count(*) AS rows FROM ({T}) t WHERE session_id NOT IN (SELECT session_id FROM gone)
 UNION ALL SELECT 'items', count(*) FROM ({I}) i WHERE session_id NOT IN (SELECT session_id FROM gone)
 UNION ALL SELECT 'occurrences', count(*) FROM ({OCC}) o JOIN ({T}) t USING (record_id) WHERE session_id NOT IN (SELECT session_id FROM gone)
 UNION ALL SELECT 'associations', count(*) FROM ({MAP}) m WHERE target NOT IN (SELECT session_id FROM gone)
   AND target NOT IN (SELECT record_id FROM ({T}) t WHERE session_id IN (SELECT session_id FROM gone))""")
def forget_cascade(spark, sf_dir):
    """Rows left after forgetting the sessions that assistants dominate."""
    records = E.records(spark, sf_dir)
    gone = records.groupBy("session_id").agg(
        F.count_if(F.col("actor") == "assistant").alias("a"), F.count(F.lit(1)).alias("n")
    ).filter("a > n / 4")
    tables = {
        "records": records, "items": E.items(spark, sf_dir), "occurrences": E.derived(spark, sf_dir, E.OCCURRENCES),
        "associations": E.derived(spark, sf_dir, _MAPPINGS),
    }
    return views.entity_counts(retention.forget(tables, gone))


@query(f"SELECT session_id, native_id, actor, kind, count(*) AS copies FROM ({T}) t GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_records(spark, sf_dir):
    return views.duplicate_records(E.records(spark, sf_dir))


@query(f"""SELECT 'records' AS entity, count(*) AS rows FROM ({T}) t UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM ({T}) t
 UNION ALL SELECT 'items', count(*) FROM ({I}) i""")
def entity_counts(spark, sf_dir):
    records = E.records(spark, sf_dir)
    return views.entity_counts(
        {"records": records, "sessions": records.select("session_id").distinct(), "items": E.items(spark, sf_dir)}
    )


@query(f"""SELECT 'items.record_id' AS "check", count(*) AS orphans FROM ({I}) i WHERE record_id NOT IN (SELECT record_id FROM ({T}) t)
 UNION ALL SELECT 'occurrences.generation_id', count(*) FROM ({OCC}) o WHERE generation_id NOT IN (SELECT generation_id FROM ({GEN}) g)
 UNION ALL SELECT 'occurrences.record_id', count(*) FROM ({OCC}) o WHERE record_id NOT IN (SELECT record_id FROM ({T}) t)
 UNION ALL SELECT 'generations.source_id', count(*) FROM ({GEN}) g WHERE source_id NOT IN (SELECT source_id FROM ({SRC}) s)""")
def integrity(spark, sf_dir):
    tables = {
        "records": E.records(spark, sf_dir), "items": E.items(spark, sf_dir),
        "occurrences": E.derived(spark, sf_dir, E.OCCURRENCES), "generations": E.derived(spark, sf_dir, E.GENERATIONS),
        "sources": E.derived(spark, sf_dir, E.SOURCES),
    }
    return views.integrity(tables).select("check", "orphans")


def _activity(spark, sf_dir):
    return E.derived(spark, sf_dir, E.ACTIVITY).withColumnRenamed("called_at", "at")


@query(f"""SELECT count(*) AS calls, count(*) FILTER (status <> 'ok') AS failures, round(avg(duration_ms), 4) AS mean_ms
 FROM ({ACT}) a WHERE called_at > TIMESTAMP '2024-01-14 12:00:00'""")
def activity_stats(spark, sf_dir):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return views.activity_stats(_activity(spark, sf_dir), now).withColumn("mean_ms", F.round("mean_ms", 4))


@query(f"SELECT activity_id, tool, status FROM ({ACT}) a WHERE activity_id < 700 ORDER BY activity_id DESC LIMIT 51")
def activity_page(spark, sf_dir):
    return views.activity_page(_activity(spark, sf_dir), 50, before=700).select("activity_id", "tool", "status")


@query(f"""SELECT epoch_us(w) AS window_us, tool, count(*) AS calls, count(*) FILTER (status <> 'ok') AS failures, sum(duration_ms)::BIGINT AS total_ms
 FROM (SELECT *, unnest(generate_series(date_trunc('hour', called_at) - INTERVAL 23 HOUR, date_trunc('hour', called_at), INTERVAL 1 HOUR)) AS w
 FROM ({ACT}) a) x GROUP BY w, tool""")
def hourly_activity(spark, sf_dir):
    return views.hourly_activity(_activity(spark, sf_dir)).select(
        F.unix_micros("window_start").alias("window_us"), "tool", "calls", "failures", "total_ms"
    )


@query("""WITH lost AS (SELECT text, count(*) AS n, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
 found AS (SELECT text, count(*) AS n, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
 SELECT concat('s', lost.doc_id) AS source_id, concat('/old/', lost.doc_id) AS old_path, concat('/new/', found.doc_id) AS new_path
 FROM lost JOIN found ON lost.text = found.text WHERE lost.n = 1 AND found.n = 1""")
def renamed_sources(spark, sf_dir):
    """Every third document vanished from its path; where its content appears once at one new path, it moved."""
    number = F.col("doc_id").cast("string")
    gone = F.col("doc_id") % 3 == 0
    rows = E.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), number).alias("source_id"),
        F.concat(F.when(gone, "/old/").otherwise("/new/"), number).alias("path"),
        F.when(gone, "missing").otherwise("new").alias("change"), F.sha2("text", 256).alias("fingerprint"),
    )
    prints = rows.select("path", "fingerprint")
    return manifest.match_renames(rows.drop("fingerprint"), prints, prints)


@query(f"""SELECT record_id, places FROM (
 SELECT t.record_id, count(o.record_id) AS places, max(event_time) AS seen FROM (SELECT * FROM ({T}) t WHERE session_id = 's5') t
 JOIN ({OCC}) o ON o.record_id = t.record_id GROUP BY 1) r ORDER BY seen DESC NULLS LAST, record_id LIMIT 50""")
def session_detail(spark, sf_dir):
    return views.session_detail(E.records(spark, sf_dir), _located(spark, sf_dir), "s5").select(
        "record_id", F.col("places").cast("long").alias("places")
    )


@query("""SELECT user_id % 5 AS part, count(*) AS lines, count(*) FILTER (event_id % 89 = 0 OR event_id % 97 = 0) AS malformed,
 sum(CASE WHEN event_id % 89 <> 0 AND event_id % 97 <> 0 THEN line_no * event_id END)::BIGINT AS ordered, sum(size)::BIGINT AS bytes
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS line_no,
  1 + CASE WHEN event_id % 97 = 0 THEN 7 WHEN event_id % 89 = 0 THEN 3 ELSE 13 + length(CAST(event_id AS VARCHAR)) END AS size FROM events) e GROUP BY 1""")
def scanned_transcripts(spark, sf_dir):
    """Files of lines, some malformed, written, listed, and read back with their numbers."""
    number = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 97 == 0, "{broken").when(F.col("event_id") % 89 == 0, "[1]").otherwise(
        F.concat(F.lit('{"event_id":'), number, F.lit("}"))
    )
    folder = f"{session.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    block = F.floor(F.col("event_id") / 20000).alias("block")
    rows = E.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("part"), block, "event_id", value.alias("value"))
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block", "event_id").drop("event_id")
    rows.write.partitionBy("part", "block").text(folder)
    part = F.regexp_extract("source_path", "/part=([0-9]+)/", 1).cast("bigint").alias("part")
    block = F.regexp_extract("source_path", "/block=([0-9]+)/", 1).cast("bigint").alias("block")
    parsed = transcripts.parse_lines(transcripts.read_transcripts(spark, folder, glob="part-*"))
    number = jsonops.int_at(F.col("body"), "$.event_id")
    files = parsed.groupBy(part, block).agg(
        F.count("*").alias("lines"), F.count_if(F.col("code") == "malformed_record").alias("malformed"),
        F.sum(F.col("line_no") * number).alias("ordered"), F.sum(number).alias("ids"),
    )
    earlier = F.sum("lines").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = files.withColumn("earlier", F.coalesce(earlier, F.lit(0))).groupBy("part").agg(
        F.sum("lines").alias("lines"), F.sum("malformed").alias("malformed"),
        F.sum(F.col("ordered") + F.col("earlier") * F.col("ids")).cast("long").alias("ordered"),
    )
    listed = manifest.build_manifest(spark, [folder], "codex", "part-*").select(
        F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("bigint").alias("part"), F.col("length").alias("bytes")
    )
    return counts.join(listed.groupBy("part").agg(F.sum("bytes").alias("bytes")), "part")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run, event_type, count(*) AS records, sum(event_id)::BIGINT AS ids
 FROM events GROUP BY 1, 2""")
def appended_records(spark, sf_dir):
    """Of two overlapping appends, the first writer of a key wins."""
    path = f"{session.shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    events = E.table(spark, sf_dir, "events").select("event_id", "event_type")
    shape = "event_id long, event_type string, run int"
    for run, rows in ((1, events.filter("event_id % 2 = 0")), (2, events.union(events))):
        sinks.append_new(rows.withColumn("run", F.lit(run)), sinks.read_table(spark, path, shape), ["event_id"], path)
    stored = sinks.read_table(spark, path, shape)
    return stored.groupBy("run", "event_type").agg(F.count("*").alias("records"), F.sum("event_id").alias("ids"))


@query(f"""SELECT COALESCE(project_id, 'unassociated') AS scope, concat('Keep probe ', CAST(substring(record_id, 2) AS INT), ' explicit.') AS text,
 record_id FROM ({T}) t WHERE actor = 'user'""")
def proposed_principles(spark, sf_dir):
    """A stated principle becomes a proposal in the scope of its record's project."""
    number = F.expr("cast(substring(record_id, 2) as int)").cast("string")
    records = E.spread_records(spark, sf_dir).filter("actor = 'user'").withColumn(
        "full_text", F.concat(F.lit("PRINCIPLE: Keep probe "), number, F.lit(" explicit."))
    )
    found = extract.proposed_principles(extract.extract_items(records), records, F.lit("2026-01-01").cast("timestamp"))
    return found.filter("status = 'proposed'").select("scope", "text", F.element_at("refs", 1).alias("record_id"))


def _spelled(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _spelled_records(spark, sf_dir, names, text):
    """User records whose text starts from the spelling that an event's number picks."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    rows = E.spread(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("record_id"), name.alias("name"))
    return rows.select(
        "record_id", "name", F.lit("codex").alias("provider"), F.lit("user").alias("actor"), F.lit("user_intent").alias("kind"),
        text(F.col("name"), F.col("record_id")).alias("full_text"), F.lit(None).cast("string").alias("tool"),
    )


_KINDS = [P.MARKERS[n] for n in P.MARKERS]


@query(f"""SELECT event_id::VARCHAR AS record_id, name,
 CASE WHEN meaning IN ('cancelled', 'superseded', 'user_completed') THEN 'correction' ELSE meaning END AS kind,
 CASE WHEN meaning IN ('cancelled', 'superseded', 'user_completed') THEN meaning ELSE '-' END AS change
 FROM (SELECT event_id, {_spelled(list(P.MARKERS))}[event_id % {len(P.MARKERS)} + 1] AS name,
  {_spelled(_KINDS)}[event_id % {len(P.MARKERS)} + 1] AS meaning FROM events) e""")
def marker_spellings(spark, sf_dir):
    """Every spelling of a marker gives one item of its kind."""
    records = _spelled_records(spark, sf_dir, list(P.MARKERS), lambda n, i: F.concat(n, F.lit(": Probe "), i, F.lit(" stays in view.")))
    items = extract.extract_items(records.drop("name")).select("record_id", "kind", "status")
    return items.join(records.select("record_id", "name"), "record_id").select(
        "record_id", "name", "kind", F.when(F.col("kind") == "correction", F.col("status")).otherwise("-").alias("change")
    )


@query(f"""SELECT event_id::VARCHAR AS record_id, CASE WHEN meaning = 'priority' THEN 'high' END AS priority,
 CASE WHEN meaning = 'rationale' THEN 'high' END AS rationale, CASE WHEN meaning = 'dependencies' THEN 'high' ELSE '' END AS dependencies
 FROM (SELECT event_id, {_spelled([P.ATTRIBUTE_NAMES[n] for n in P.ATTRIBUTE_NAMES])}[event_id % {len(P.ATTRIBUTE_NAMES)} + 1] AS meaning FROM events) e""")
def attribute_lines(spark, sf_dir):
    """Every spelling of an attribute on its own line belongs to the item above it."""
    records = _spelled_records(
        spark, sf_dir, list(P.ATTRIBUTE_NAMES),
        lambda n, i: F.concat(F.lit("TASK: Repair probe "), i, F.lit(".\n"), n, F.lit(": high")),
    )
    return extract.extract_items(records.drop("name")).select(
        "record_id", "priority", "rationale", F.array_join("dependencies", ",").alias("dependencies")
    )


# Who says what, and the item that must come of it; a percent sign stands for a number.
_SAID = [
    ("user", "Please inspect probe %.", "next_action", "active", "user_intent"),
    ("user", "If probe % fails we stop.", "constraint", "recorded", "recorded_instruction"),
    ("user", "Cancel probe %.", "correction", "cancelled", "user_correction"),
    ("user", "Probe % was completed.", "correction", "user_completed", "user_correction"),
    ("user", "Probe % is deferred.", "context", "deferred", "recorded_instruction"),
    ("user", "Probe % is blocked.", "blocker", "blocked", "user_intent"),
    ("user", "Probe % is unfinished.", "task", "active", "user_intent"),
    ("user", "No pending work on probe %.", "context", "reported", "user_report"),
    ("user", "Thanks!", "conversation", "unresolved", "conversation_management"),
    ("user", "For example probe % is blocked.", None, None, None),
    ("assistant", "Probe % is blocked.", "blocker", "blocked", "agent_claim"),
    ("assistant", "Probe % is unfinished.", "task", "active", "agent_claim"),
    ("assistant", "If probe % fails we stop.", "constraint", "recorded", "agent_proposal"),
    ("assistant", "Probe % is deferred.", "context", "deferred", "agent_proposal"),
    ("assistant", "Probe % was fixed and verified.", "claim", "unverified", "agent_claim"),
    ("assistant", "NEXT: Inspect probe %.", "next_action", "proposed", "agent_proposal"),
    ("assistant", "DONE: Probe % runs.", "claim", "unverified", "agent_claim"),
    ("assistant", "Cancel probe %.", None, None, None),
]
_SAID_SQL = ", ".join(
    f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in (row[0], *row[2:])) + ")" for i, row in enumerate(_SAID)
)


@query(f"""SELECT event_id::VARCHAR AS record_id, actor, kind, status, category FROM events
 JOIN (VALUES {_SAID_SQL}) s(i, actor, kind, status, category) ON event_id % {len(_SAID)} = i WHERE kind IS NOT NULL""")
def prose_rungs(spark, sf_dir):
    """Each rule for unmarked sentences, by who says them."""
    pick = lambda k: F.element_at(F.array(*[F.lit(row[k]) for row in _SAID]), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    number = F.col("event_id").cast("string")
    records = E.spread(spark, sf_dir, "events").select(
        number.alias("record_id"), F.lit("codex").alias("provider"), pick(0).alias("actor"),
        F.when(pick(0) == "user", "user_intent").otherwise("agent_claim").alias("kind"),
        F.replace(pick(1), F.lit("%"), number).alias("full_text"), F.lit(None).cast("string").alias("tool"),
    )
    items = extract.extract_items(records).select("record_id", "kind", "status", "category")
    return items.join(records.select("record_id", "actor"), "record_id").select("record_id", "actor", "kind", "status", "category")


_MEMORY = """SELECT concat('m', CAST(p_partkey % 400 AS STRING)) AS memory_id, 'principle' AS kind, p_name AS text,
 CASE WHEN p_partkey % 4 = 0 THEN 'accepted' WHEN p_partkey % 4 = 1 THEN 'rejected' ELSE 'proposed' END AS status,
 CASE WHEN p_partkey % 3 = 0 THEN 'explicit' ELSE 'inferred' END AS origin,
 CASE WHEN p_partkey % 5 = 0 THEN 'global' ELSE 'p1' END AS scope, p_partkey AS changed FROM {part}"""
MEM = E.for_check(_MEMORY, "part")


@query(f"""SELECT memory_id, text, status, CASE WHEN origin = 'explicit' THEN 'explicit' WHEN status = 'accepted'
  THEN 'accepted_inference; origin remains inferred' ELSE 'proposal_only; requires acceptance' END AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY changed DESC) AS rn FROM ({MEM}) m) x
 WHERE rn = 1 AND scope IN ('global', 'p1')""")
def principles(spark, sf_dir):
    """Current principles from the memory change log."""
    log = E.derived(spark, sf_dir, _MEMORY, "part").withColumns(
        {"updated_at": F.timestamp_seconds("changed"), "created_at": F.timestamp_seconds("changed")}
    )
    return views.principles(views.current_memory(log), "p1").select("memory_id", "text", "status", "confidence")


# --- context -----------------------------------------------------------------------------------------


def _dialogue(spark, sf_dir):
    """Conversations as records of one project per tenth conversation."""
    c = E.table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    return c.select(
        F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("record_id"),
        F.concat(F.lit("p"), F.floor(F.col("conv_id") / 10).cast("string")).alias("project_id"),
        F.concat(F.lit("w"), F.col("conv_id").cast("string")).alias("worktree_id"),
        F.col("role").alias("actor"),
        F.when(F.col("role") == "user", "user_intent").when(F.col("role") == "assistant", "agent_claim").otherwise("metadata").alias("kind"),
        F.lit("codex").alias("provider"), "text",
        F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 100 + F.col("turn")).alias("event_time"),
        F.lit("known").alias("time_status"),
        null.alias("event_type"), null.alias("revision"), F.lit(None).cast("bigint").alias("exit_status"),
    )


_DIALOGUE = """SELECT 'r' || conv_id || '-' || turn AS record_id, 'p' || CAST(conv_id // 10 AS VARCHAR) AS project_id, role AS actor, text,
 1700000000 + conv_id * 100 + turn AS said_at FROM conversations"""
_RECENT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY said_at DESC, record_id) AS recency FROM ({_DIALOGUE}) d
 WHERE actor IN ('user', 'assistant')) r WHERE recency <= 60"""


@query(f"SELECT project_id, recency, record_id FROM ({_RECENT}) w")
def recent_context(spark, sf_dir):
    return context.recent_context(_dialogue(spark, sf_dir)).select(
        "project_id", F.col("recency").cast("long").alias("recency"), "record_id"
    )


@query(f"""SELECT project_id, record_id, substring(text, 1, 4000) AS text, GREATEST(0, length(text) - 4000) AS omitted_chars FROM (
 SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY said_at DESC, record_id) AS rn FROM ({_DIALOGUE}) d WHERE actor = 'user') r WHERE rn = 1""")
def latest_instruction(spark, sf_dir):
    d = _dialogue(spark, sf_dir)
    return context.latest_instruction(d, d.select("record_id")).select(
        "project_id", "record_id", "text", F.col("omitted_chars").cast("long").alias("omitted_chars")
    )


@query(f"SELECT project_id, record_id, text FROM ({_RECENT}) w WHERE recency = 1")
def stopping_point(spark, sf_dir):
    return context.stopping_point(context.recent_context(_dialogue(spark, sf_dir))).select("project_id", "record_id", "text")


@query(f"""SELECT w.project_id, rank, record_id, substring(text, 1, 900) AS text FROM (
 SELECT w.*, row_number() OVER (PARTITION BY w.project_id ORDER BY recency) AS rank FROM ({_RECENT}) w
 LEFT JOIN (SELECT project_id, max(said_at) AS since FROM ({_DIALOGUE}) d WHERE actor = 'user' GROUP BY project_id) u ON u.project_id = w.project_id
 WHERE actor = 'assistant' AND (since IS NULL OR said_at >= since)) w WHERE rank <= 3""")
def agent_updates(spark, sf_dir):
    d = _dialogue(spark, sf_dir)
    window = context.recent_context(d)
    return context.agent_updates(window, context.latest_instruction(d, d.select("record_id"))).select(
        "project_id", F.col("rank").cast("long").alias("rank"), "record_id", "text"
    )


# --- search, briefing, packing ----------------------------------------------------------------------


def _bm25(terms: list[str], limit: int) -> str:
    toks = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl))"
        for i in range(len(terms))
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT doc_id, {toks} AS toks FROM documents), c AS (SELECT doc_id, len(toks) AS len, {tf} FROM d),
 s AS (SELECT count(*) AS n, avg(len) AS avgdl, {df} FROM c)
 SELECT doc_id, round(-({part}), 6) AS score FROM c, s WHERE {every} ORDER BY -({part}), doc_id LIMIT {limit}"""


@query(_bm25(["the", "tion"], 20))
def search_documents(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(d, "The tion", 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25(["the", "tion"], 20))
def search_index(spark, sf_dir):
    """The same search, answered from a written index."""
    path = f"{session.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    search.build_index(E.spread(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", term_buckets=16, document_buckets=2)
    found = search.search_index(spark, path, "The tion", 20, term_buckets=16)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""SELECT source, facet_rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS facet_rank FROM (
 SELECT doc_id, source, length(text) AS size, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS once FROM documents) d
 WHERE once = 1) r WHERE facet_rank <= 6""")
def distinct_statements(spark, sf_dir):
    """Shortest distinct texts per source; equal wording in two languages counts twice."""
    d = E.spread(spark, sf_dir, "documents").withColumn("worktree_id", F.col("lang"))
    return facets.distinct_top(d, ["source"], [F.length("text").asc(), F.col("doc_id").asc()], 6).select(
        "source", F.col("facet_rank").cast("long").alias("facet_rank"), "doc_id"
    )


_PACK = """WITH RECURSIVE e AS (SELECT source, doc_id, length(text) + 24 AS cost,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
 walk AS (SELECT source, rn, doc_id, CASE WHEN cost <= 23999 THEN cost ELSE 0 END AS used, cost <= 23999 AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.source, e.rn, e.doc_id, CASE WHEN w.used + e.cost <= 23999 THEN w.used + e.cost ELSE w.used END,
   w.used + e.cost <= 23999 FROM walk w JOIN e ON e.source = w.source AND e.rn = w.rn + 1)
 SELECT source, row_number() OVER (PARTITION BY source ORDER BY rn) AS position, doc_id, used FROM walk WHERE kept"""


@query(_PACK)
def packed_documents(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return pack.pack(d, 24000, [], group="source", entry_id="doc_id").select(
        "source", F.col("position").cast("long").alias("position"), "doc_id", F.col("used").cast("long").alias("used")
    )


@query(_PACK.replace("SELECT source, row_number() OVER (PARTITION BY source ORDER BY rn) AS position, doc_id, used FROM walk WHERE kept",
 "SELECT d.source, d.lang, count(*) AS total, count(*) FILTER (NOT w.kept) AS omitted FROM walk w JOIN documents d ON d.doc_id = w.doc_id GROUP BY 1, 2"))
def pack_omissions(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    kept = pack.pack(d, 24000, [], group="source", entry_id="doc_id")
    return pack.omissions(d, kept, "lang", "source")


@query(_PACK.replace("SELECT source, row_number() OVER (PARTITION BY source ORDER BY rn) AS position, doc_id, used FROM walk WHERE kept",
 """, k AS (SELECT w.source, w.doc_id, d.lang, w.rn FROM walk w JOIN documents d ON d.doc_id = w.doc_id WHERE kept),
 f AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY min(rn)) AS n FROM k GROUP BY source, lang)
 SELECT k.source, k.doc_id, 'document_observation_' || f.n AS observation_ref FROM k JOIN f ON f.source = k.source AND f.lang = k.lang"""))
def shared_observations(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    kept = pack.pack(d, 24000, [], group="source", entry_id="doc_id")
    return pack.share_observations(kept, ["lang"], "source").select("source", "doc_id", "observation_ref")


@query(f"""WITH picked AS (SELECT * FROM ({I}) i WHERE kind IN ('task','next_action','blocker')),
 placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {IMPORTANCE}, event_time DESC NULLS LAST, item_id DESC) AS r FROM picked),
 slots AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY project_id ORDER BY {IMPORTANCE}, event_time DESC NULLS LAST, item_id DESC) AS r
   FROM picked WHERE kind IN ('task','next_action') AND status IN ('active','pending','blocked')) x WHERE r <= 5),
 final AS (SELECT p.*, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN s.item_id IS NULL THEN 1 ELSE 0 END, r) AS rank
   FROM placed p LEFT JOIN slots s ON s.item_id = p.item_id)
 SELECT COALESCE(project_id, '-') AS project_id, place, item_id, CASE WHEN worktree_id LIKE 'w1%' THEN 'current' ELSE 'worktree_unavailable_verify_location' END AS availability
 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN kind = 'next_action' THEN 0 ELSE 1 END, rank) AS place
  FROM final WHERE rank <= 50 AND kind IN ('task','next_action') AND status IN ('active','pending','blocked')) a WHERE place <= 5""")
def next_actions(spark, sf_dir):
    items = E.items(spark, sf_dir)
    trees = items.select("worktree_id").distinct().withColumn("active", F.col("worktree_id").like("w1%"))
    chosen = resolve.rank_items(resolve.select_items(items, ["task", "next_action", "blocker"]), 50, prioritize_active=True)
    return context.next_actions(chosen, trees).select(
        F.coalesce("project_id", F.lit("-")).alias("project_id"), F.col("place").cast("long").alias("place"), "item_id", "availability"
    )


@query(f"""WITH refs AS (SELECT 'm' || p_partkey AS memory_id, 0 AS position, 'r' || (p_partkey * 7) AS record_id FROM part
  UNION ALL SELECT 'm' || p_partkey, 1, 'r' || (p_partkey * 3) FROM part),
 st AS (SELECT o.record_id, bool_or(g.status = 'current' AND s.status IN ('ready', 'partial')) AS live FROM ({OCC}) o
  JOIN ({GEN}) g USING (generation_id) JOIN ({SRC}) s USING (source_id) GROUP BY 1)
 SELECT memory_id, position, CASE WHEN t.record_id IS NULL THEN 'removed_or_unknown' WHEN st.live THEN 'current' ELSE 'missing_or_superseded' END AS evidence_status
 FROM refs LEFT JOIN ({T}) t ON t.record_id = refs.record_id LEFT JOIN st ON st.record_id = refs.record_id""")
def memory_evidence(spark, sf_dir):
    ref = lambda n: F.concat(F.lit("r"), (F.col("p_partkey") * n).cast("string"))
    memory = E.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("memory_id"), F.array(ref(7), ref(3)).alias("refs")
    )
    return views.memory_evidence(memory, E.records(spark, sf_dir), _located(spark, sf_dir)).select(
        "memory_id", "position", "evidence_status"
    )


@query(f"""WITH o AS (SELECT item_id, session_id AS record_id, text FROM ({I}) i),
 single AS (SELECT record_id, text, min(item_id) AS old_id FROM o GROUP BY 1, 2 HAVING count(*) = 1),
 c AS (SELECT correction_id, replace(target, 'r', 'i') AS target FROM ({COR}) c)
 SELECT target, count(*) AS corrections FROM (SELECT target FROM c UNION ALL
  SELECT 'new-' || s.old_id FROM c JOIN single s ON s.old_id = c.target) x GROUP BY target""")
def carried_overrides(spark, sf_dir):
    """Re-extraction gives every item a new id; corrections follow unambiguous wording."""
    old = E.items(spark, sf_dir).select("item_id", F.col("session_id").alias("record_id"), "text")
    new = old.withColumn("item_id", F.concat(F.lit("new-"), F.col("item_id")))
    single = old.groupBy("record_id", "text").agg(F.count(F.lit(1)).alias("n"))
    unique_new = new.join(single.filter("n = 1"), ["record_id", "text"], "left_semi")
    corrections = E.derived(spark, sf_dir, E.CORRECTIONS).withColumn("target", F.replace("target", F.lit("r"), F.lit("i")))
    return identity.carry_overrides(old, unique_new, corrections).groupBy("target").agg(F.count(F.lit(1)).alias("corrections"))


@query("""WITH prior AS (SELECT o_custkey AS path, count(*) AS length, max(o_orderdate) AS modified FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
 listing AS (SELECT o_custkey AS path, count(*) AS length, max(o_orderdate) AS modified FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT CAST(COALESCE(l.path, p.path) AS VARCHAR) AS path, CASE WHEN l.path IS NULL THEN 'missing' WHEN p.path IS NULL THEN 'new'
  WHEN l.length = p.length AND l.modified = p.modified THEN 'unchanged' ELSE 'replaced' END AS change
 FROM listing l FULL OUTER JOIN prior p ON p.path = l.path""")
def source_changes(spark, sf_dir):
    """Order counts per customer as two listings of the same sources."""
    orders = E.table(spark, sf_dir, "orders")
    listed = lambda rows: rows.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(
        F.count(F.lit(1)).alias("length"), F.max("o_orderdate").cast("timestamp").alias("modified_at")
    ).withColumn("provider", F.lit("codex"))
    prior = listed(orders.filter("o_orderstatus <> 'O'")).withColumns(
        {"source_id": F.col("path"), "status": F.lit("ready"), "generation": F.lit(1), "line": F.lit(0).cast("long"),
         "prefix_hash": F.lit(None).cast("string")}
    )
    return manifest.classify_sources(prior, listed(orders.filter("o_orderstatus <> 'P'"))).select("path", "change")


_PLACES = """SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS seen_at,
 concat('/u/', CAST(user_id AS STRING), '/', CAST(CAST(floor(value) AS INT) % 3 AS STRING)) AS path FROM {events}"""


@query(f"""WITH e AS ({_PLACES.format(events='events')}),
 former AS (SELECT user_id, path, min(seen_at) AS since FROM e WHERE path <> '/u/' || user_id || '/0' GROUP BY 1, 2),
 spans AS (SELECT f.*, (SELECT min(a.seen_at) FROM e a WHERE a.user_id = f.user_id AND a.path = '/u/' || f.user_id || '/0' AND a.seen_at >= f.since) AS until FROM former f)
 SELECT 'r' || e.event_id AS record_id, 'w' || e.user_id AS worktree_id FROM e JOIN spans s ON s.path = e.path AND e.seen_at BETWEEN s.since AND s.until""")
def identity_intervals(spark, sf_dir):
    """Every event observes its user's worktree at one of three paths; the first is the present one."""
    e = E.derived(spark, sf_dir, _PLACES)
    tree = F.concat(F.lit("w"), F.col("user_id").cast("string"))
    home = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/0"))
    worktrees = e.select(tree.alias("worktree_id"), F.lit("p").alias("project_id"), tree.alias("identity"), home.alias("path"), F.lit(True).alias("active")).distinct()
    projects = e.select(F.lit("p").alias("project_id"), F.lit("c").alias("common_identity")).distinct()
    observations = e.select(
        F.col("event_id").alias("observation_id"), tree.alias("worktree_id"), F.col("seen_at").alias("observed_at"),
        F.struct("path", tree.alias("worktree_identity"), F.lit("c").alias("common_identity"), F.lit(True).alias("available")).alias("data"),
    )
    live = e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.col("seen_at").alias("event_time"),
        F.lit("known").alias("time_status"), F.lit(None).cast("string").alias("project_id"),
        F.lit(None).cast("string").alias("association_reason"), F.col("path").alias("cwd"),
    )
    spans = moves.identity_intervals(observations, worktrees, projects)
    return moves.associate_by_interval(live, spans).select("record_id", "worktree_id")


@query()
def document_statements(spark, sf_dir):
    """Statements found in the sections of all documents, per kind."""
    d = E.spread(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit(".md")).alias("relative_path"),
        F.lit("/d").alias("root_path"), F.sha2("text", 256).alias("fingerprint"), "text",
    )
    r = docs.section_records(d, F.lit("2026-01-01").cast("timestamp"))
    m = F.col("metadata")
    shaped = r.select(
        "record_id", "kind", "full_text", m["section"].alias("section"), m["relative_path"].alias("relative_path"),
        m["line_start"].alias("line_start"), m["source_context"].alias("source_context"),
    )
    return docs.document_items(shaped).groupBy("kind", "status", "category").agg(F.count(F.lit(1)).alias("items"))
