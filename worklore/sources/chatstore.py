"""Relational chat-store input: `sessions` and `messages` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P
from ..operators.identity import without_copies

OPTIONAL = {
    "tool_call_id": "string", "tool_calls": "string", "tool_name": "string", "active": "int",
    "compacted": "int", "_compressed_summary": "int", "display_kind": "string",
}
SESSION_OPTIONAL = {
    "cwd": "string", "git_branch": "string", "git_repo_root": "string",
    "parent_session_id": "string", "ended_at": "double", "end_reason": "string",
}


def _with_optional(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns a producer version lacks become NULL."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    )


def read_message_store(
    sessions: DataFrame, messages: DataFrame, after_id: int = 0, most_bytes: int | None = None
) -> DataFrame:
    """Visible, de-duplicated messages with their session's context.

    With most_bytes, longer fields become NULL and are marked before the join.
    """
    lacking = {"id", "session_id", "role", "content", "timestamp"} - set(messages.columns)
    if lacking or not {"id", "started_at"} <= set(sessions.columns):
        raise ValueError("Unsupported sessions/messages schema")
    has = set(messages.columns)
    rows = _with_optional(messages, OPTIONAL).filter(F.col("id") > after_id)
    if {"active", "compacted", "tool_calls", "tool_call_id", "tool_name"} <= has:
        rows = without_copies(rows)
    elif {"active", "compacted"} <= has:
        rows = rows.filter((F.col("active") == 1) | (F.col("compacted") == 1))
    elif "active" in has:
        rows = rows.filter(F.col("active") == 1)
    fields = ["content", "tool_calls", "tool_call_id", "tool_name", "role", "display_kind"]
    large = lambda c: F.lit(False) if most_bytes is None else F.coalesce(F.octet_length(c), F.lit(0)) > most_bytes
    oversized: Column = F.lit(False)
    for name in fields:
        oversized = oversized | large(name)
    bounded = rows.withColumn("_oversized", oversized).withColumns(
        {name: F.when(~large(name), F.col(name)) for name in fields}
    )
    context = _with_optional(sessions, SESSION_OPTIONAL).select(
        F.col("id").alias("_session"),
        *[F.col(c).alias("session_" + c) for c in SESSION_OPTIONAL],
    )
    return bounded.join(context, bounded.session_id == F.col("_session")).drop("_session")
