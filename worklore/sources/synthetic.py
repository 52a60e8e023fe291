"""Deterministic transcript corpus for ingestion measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# sessions, records per session, bytes of the whole corpus
PRESETS = {
    "tiny": (8, 20, 196_608),
    "small": (100, 100, 10_485_760),
    "large": (1_000, 250, 262_144_000),
}
FILLER = "The worker keeps one bounded retry and reports what it observed before going on. "


def _marker(index: Column, session: Column) -> Column:
    s = session.cast("string")
    return (
        F.when(index == 1, F.concat(F.lit("TASK: [item-"), s, F.lit("] Add a bounded retry.\n")))
        .when(index == 2, F.concat(F.lit("BLOCKER: [stop-"), s, F.lit("] A dependency is unavailable.\n")))
        .when(index == 3, F.concat(F.lit("NEXT: [step-"), s, F.lit("] Inspect the retry log.\n")))
        .when(index == 6, F.concat(F.lit("DECISION: Keep the retry bound explicit in "), s, F.lit(".\n")))
        .otherwise(F.concat(F.lit("Observation "), s, F.lit("/"), index.cast("string"), F.lit(". ")))
    )


def generate(spark: SparkSession, preset: str = "tiny") -> DataFrame:
    """Lines of both file formats: provider, session, line_no, value."""
    sessions, per_session, size = PRESETS[preset]
    filler_size = max(0, size // (sessions * per_session) - 420)
    rows = spark.range(sessions * per_session).select(
        F.floor(F.col("id") / per_session).alias("session"),
        (F.col("id") % per_session).alias("index"),
    )
    session, index = F.col("session"), F.col("index")
    sid = F.sha2(F.concat(F.lit("session/"), session.cast("string")), 224)
    rid = F.sha2(F.concat(F.lit("record/"), session.cast("string"), F.lit("/"), index.cast("string")), 224)
    at = F.date_format(
        F.timestamp_seconds(F.lit(1767225600) + session * 1000 + index), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    filler = F.substring(F.repeat(F.lit(FILLER), filler_size // len(FILLER) + 1), 1, filler_size)
    user = index.isin(1, 2, 3, 6) | (index % 5 == 0)
    role = F.when(user, "user").otherwise("assistant")
    text = F.concat(_marker(index, session), filler)
    cwd = F.concat(F.lit("/repos/r"), (session % 20).cast("string"))
    call_id = F.concat(F.lit("call-"), session.cast("string"), F.lit("-"), (index - index % 10 + 4).cast("string"))
    call, result = index % 10 == 4, index % 10 == 9
    arguments = F.to_json(F.struct(F.concat(F.lit("printf synthetic # "), filler).alias("command")))

    part = F.struct(F.when(user, "input_text").otherwise("output_text").alias("type"), text.alias("text"))
    envelope = lambda kind, payload: F.to_json(
        F.struct(at.alias("timestamp"), index.alias("ordinal"), F.lit(kind).alias("type"), payload.alias("payload"))
    )
    rollout = (
        F.when(index == 0, envelope("session_meta", F.struct(sid.alias("id"), cwd.alias("cwd"), F.lit("0").alias("cli_version"))))
        .when(call, envelope("response_item", F.struct(F.lit("function_call").alias("type"), rid.alias("id"), call_id.alias("call_id"), F.lit("terminal").alias("name"), arguments.alias("arguments"))))
        .when(result, envelope("response_item", F.struct(F.lit("function_call_output").alias("type"), rid.alias("id"), call_id.alias("call_id"), filler.alias("output"))))
        .otherwise(envelope("response_item", F.struct(F.lit("message").alias("type"), rid.alias("id"), role.alias("role"), F.array(part).alias("content"))))
    )
    entry = lambda kind, block: F.to_json(
        F.struct(
            kind.alias("type"), rid.alias("uuid"), sid.alias("sessionId"), cwd.alias("cwd"), at.alias("timestamp"),
            F.struct(kind.alias("role"), F.array(block).alias("content")).alias("message"),
        )
    )
    messages = (
        F.when(call, entry(F.lit("assistant"), F.struct(F.lit("tool_use").alias("type"), call_id.alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("printf synthetic # "), filler).alias("command")).alias("input"))))
        .when(result, entry(F.lit("user"), F.struct(F.lit("tool_result").alias("type"), call_id.alias("tool_use_id"), filler.alias("content"), F.lit(False).alias("is_error"))))
        .otherwise(entry(role, F.struct(F.lit("text").alias("type"), text.alias("text"))))
    )
    return rows.select(
        F.when(session % 2 == 0, "codex").otherwise("claude").alias("provider"),
        "session", (index + 1).alias("line_no"),
        F.when(session % 2 == 0, rollout).otherwise(messages).alias("value"),
    )


def write_corpus(spark: SparkSession, path: str, preset: str = "tiny") -> None:
    """One file per session: <path>/<provider>/<session>/*.jsonl-like text folders."""
    lines = generate(spark, preset)
    sessions = PRESETS[preset][0]
    (
        lines.repartition(sessions, "provider", "session").sortWithinPartitions("provider", "session", "line_no")
        .select("provider", "session", "value")
        .write.mode("errorifexists").partitionBy("provider", "session").text(path)
    )
