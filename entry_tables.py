"""Work-history tables derived from the given tables, in SQL both engines run.

`{events}` and the other placeholders are filled with a DataFrame in Spark and
with the table name in the check engine, so both sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worklore.operators import evidence, resolve

_KEYED = """
 SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}
"""

TRANSCRIPTS = f"""
 SELECT concat('r', CAST(event_id AS STRING)) AS record_id,
        concat('s', CAST(user_id AS STRING)) AS session_id,
        concat('n', CAST(user_id AS STRING), '-', CAST(k AS STRING)) AS native_id,
        CASE WHEN event_id % 3 = 0 THEN 'codex' WHEN event_id % 3 = 1 THEN 'claude' ELSE 'hermes' END AS provider,
        CASE WHEN event_type = 'view' THEN 'assistant' ELSE 'user' END AS actor,
        CASE WHEN event_type = 'view' THEN 'agent_claim' ELSE 'user_intent' END AS kind,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS event_time,
        CASE WHEN event_id % 50 = 0 THEN 'naive' ELSE 'known' END AS time_status,
        CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('p', CAST(user_id % 7 AS STRING)) END AS project_id,
        CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('w', CAST(user_id % 14 AS STRING)) END AS worktree_id,
        CASE event_type
          WHEN 'error' THEN concat('BLOCKER: Critical: probe ', CAST(k AS STRING), ' is unavailable.')
          WHEN 'click' THEN concat('TASK: Repair probe ', CAST(k AS STRING), '. | PRIORITY: high')
          WHEN 'view' THEN concat('NEXT: Inspect probe ', CAST(k AS STRING), '.')
          WHEN 'purchase' THEN concat('DECISION: Keep probe ', CAST(k AS STRING), ' explicit.')
          ELSE concat('CANCEL: [n', CAST(user_id AS STRING), '-', CAST((k + 1) % 100 AS STRING), '] No longer needed.')
        END AS text
 FROM ({_KEYED}) keyed
"""

ITEMS = f"""
 SELECT concat('i', CAST(event_id AS STRING)) AS item_id, concat('r', CAST(event_id AS STRING)) AS record_id,
        0 AS item_no,
        CASE event_type WHEN 'error' THEN 'blocker' WHEN 'click' THEN 'task' WHEN 'view' THEN 'next_action'
          WHEN 'purchase' THEN 'decision' ELSE 'correction' END AS kind,
        CASE event_type
          WHEN 'error' THEN concat('Critical: probe ', CAST(k AS STRING), ' is unavailable.')
          WHEN 'click' THEN concat('Repair probe ', CAST(k AS STRING), '.')
          WHEN 'view' THEN concat('Inspect probe ', CAST(k AS STRING), '.')
          WHEN 'purchase' THEN concat('Keep probe ', CAST(k AS STRING), ' explicit.')
          ELSE concat('[n', CAST(user_id AS STRING), '-', CAST((k + 1) % 100 AS STRING), '] No longer needed.')
        END AS text,
        CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'proposed'
          WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'active' ELSE 'cancelled' END AS status,
        CASE event_type WHEN 'view' THEN 'agent_proposal' WHEN 'error' THEN 'user_intent'
          WHEN 'click' THEN 'user_intent' WHEN 'purchase' THEN 'user_intent' ELSE 'user_correction' END AS category,
        CASE WHEN event_type NOT IN ('error', 'click', 'view', 'purchase')
          THEN concat('n', CAST(user_id AS STRING), '-', CAST((k + 1) % 100 AS STRING)) END AS target,
        CAST(NULL AS STRING) AS rationale,
        CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'high' END AS priority,
        'explicit-v1' AS method,
        concat('s', CAST(user_id AS STRING)) AS session_id,
        concat('n', CAST(user_id AS STRING), '-', CAST(k AS STRING)) AS native_id,
        CASE WHEN event_id % 3 = 0 THEN 'codex' WHEN event_id % 3 = 1 THEN 'claude' ELSE 'hermes' END AS provider,
        CASE WHEN event_type = 'view' THEN 'assistant' ELSE 'user' END AS actor,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS event_time,
        CASE WHEN event_id % 50 = 0 THEN 'naive' ELSE 'known' END AS time_status,
        CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('p', CAST(user_id % 7 AS STRING)) END AS project_id,
        CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('w', CAST(user_id % 14 AS STRING)) END AS worktree_id
 FROM ({_KEYED}) keyed
"""

OCCURRENCES = f"""
 SELECT concat('r', CAST(event_id AS STRING)) AS record_id,
        concat('g', CAST(user_id % 20 AS STRING), '-', CASE WHEN k < 10 THEN '1' ELSE '2' END) AS generation_id,
        concat('line:', CAST(event_id AS STRING)) AS locator, event_id AS position
 FROM ({_KEYED}) first_copy
 UNION ALL
 SELECT concat('r', CAST(event_id AS STRING)) AS record_id,
        concat('g', CAST((user_id + 1) % 20 AS STRING), '-2') AS generation_id,
        concat('line:', CAST(event_id AS STRING)) AS locator, event_id AS position
 FROM ({_KEYED}) second_copy WHERE event_type = 'click' AND value > 20
"""

GENERATIONS = f"""
 SELECT DISTINCT concat('g', CAST(user_id % 20 AS STRING), '-', number) AS generation_id,
        concat('src', CAST(user_id % 20 AS STRING)) AS source_id, CAST(number AS INT) AS number,
        CASE number WHEN '1' THEN 'superseded' ELSE 'current' END AS status
 FROM (SELECT user_id, '1' AS number FROM {{events}}
       UNION ALL SELECT user_id, '2' AS number FROM {{events}}) numbered
"""

SOURCES = """
 SELECT DISTINCT concat('src', CAST(user_id % 20 AS STRING)) AS source_id,
        CASE WHEN user_id % 20 < 10 THEN 'codex' ELSE 'claude' END AS provider,
        concat('/sessions/src', CAST(user_id % 20 AS STRING), '.jsonl') AS path,
        CASE user_id % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'ready' END AS status
 FROM {events}
"""

CORRECTIONS = f"""
 SELECT concat('c', CAST(event_id AS STRING)) AS correction_id,
        concat('r', CAST(event_id - 1 - k % 40 AS STRING)) AS target,
        CASE WHEN k % 5 = 0 THEN 'Reworded by the user.' END AS text,
        CASE WHEN k % 3 = 0 THEN 'accepted' WHEN k % 3 = 1 THEN 'archived' END AS status,
        'checked' AS reason, CAST(ts AS TIMESTAMP) AS created_at
 FROM ({_KEYED}) keyed WHERE event_type = 'purchase' AND value > 10 AND (k % 3 < 2 OR k % 5 = 0)
"""

ACTIVITY = """
 SELECT event_id AS activity_id, CAST(ts AS TIMESTAMP) AS called_at, 'tool' AS surface, event_type AS tool,
        props AS summary, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CAST(floor(value * 10) AS BIGINT) AS duration_ms
 FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Dealt by key, for a file may be a single row group and the work per row is heavy."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(spark.sparkContext.defaultParallelism, rows.columns[0])


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names or ("events",)})


def for_check(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names or ("events",)})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_records(derived(spark, sf_dir, TRANSCRIPTS))


def spread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_records(spark.sql(TRANSCRIPTS, events=spread(spark, sf_dir, "events")))


def _as_records(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumns(
        {
            "full_text": F.col("text"),
            "tool": F.lit(None).cast("string"),
            "session_native_id": F.col("session_id"),
        }
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ITEMS).withColumn("dependencies", F.array().cast("array<string>"))


def current_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.current_record_ids(
        derived(spark, sf_dir, OCCURRENCES), derived(spark, sf_dir, GENERATIONS)
    )


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.item_view(items(spark, sf_dir), current_ids(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_items(view(spark, sf_dir), derived(spark, sf_dir, CORRECTIONS))


def statement_texts(events: DataFrame) -> DataFrame:
    """(event_type, block, text) of up to 3000 statements: more events give more texts, not longer ones."""
    line = F.concat(F.lit("TASK: Repair probe "), F.col("event_id").cast("string"), F.lit("."))
    return events.groupBy("event_type", F.floor(F.col("event_id") / 3000).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")
    )


def section_texts(events: DataFrame) -> DataFrame:
    """(document_id, text) of up to 6000 sections; an id is a half of the users, a point and a block."""
    number = F.col("event_id").cast("string")
    part = F.struct("event_id", F.concat(F.lit("# Probe "), number, F.lit("\nBody of probe "), number, F.lit(".")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n")
    block = F.floor(F.col("event_id") / 6000).cast("string")
    document_id = F.concat((F.col("user_id") % 2).cast("string"), F.lit("."), block).alias("document_id")
    return events.groupBy(document_id).agg(joined.alias("text"))
