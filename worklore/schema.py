"""Table schemas.  Times are UTC timestamps; unknown event times stay NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructField, StructType

# One wide, typed struct instead of a free-form map: columnar, prunable, comparable.
METADATA_FIELDS: dict[str, str] = {
    "command": "string",
    "command_argv": "array<string>",
    "exit_status": "bigint",
    "revision": "string",
    "branch": "string",
    "dirty": "boolean",
    "tool": "string",
    "call_id": "string",
    "phase": "string",
    "author": "string",
    "recipient": "string",
    "event_type": "string",
    "execution_source": "string",
    "context_cwd": "string",
    "root_session_id": "string",
    "parent_session_id": "string",
    "parent_thread_id": "string",
    "forked_from_id": "string",
    "cli_version": "string",
    "history_mode": "string",
    "history_base": "string",
    "parent_uuid": "string",
    "is_sidechain": "boolean",
    "agent_id": "string",
    "version": "string",
    "is_error": "boolean",
    "git_repo_root": "string",
    "ended_at": "double",
    "end_reason": "string",
    "document_id": "string",
    "relative_path": "string",
    "section": "string",
    "source_context": "string",
    "line_start": "int",
    "line_end": "int",
    "segment_order": "int",
    "segment_count": "int",
    "fingerprint": "string",
    "observed_at": "timestamp",
    "content_scope": "string",
    "git_head": "string",
    "committed_blob": "string",
    "tracked": "string",
    "modified": "string",
}

METADATA_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in METADATA_FIELDS.items()) + ">"

RECORDS = (
    "record_id string, session_id string, session_native_id string, native_id string, "
    "provider string, actor string, kind string, text string, event_time timestamp, "
    "original_time string, time_status string, cwd string, metadata "
    + METADATA_TYPE
    + ", project_id string, worktree_id string, association_reason string"
)
OCCURRENCES = (
    "record_id string, generation_id string, locator string, position long"
)
GENERATIONS = (
    "generation_id string, source_id string, number int, status string, created_at timestamp"
)
SOURCES = (
    "source_id string, provider string, path string, fingerprint string, length long, "
    "modified_at timestamp, status string, generation int, line long, prefix_hash string, "
    "last_refresh timestamp"
)
SOURCE_DIAGNOSTICS = (
    "source_id string, code string, message string, locator string, line_no long"
)
ITEMS = (
    "item_id string, record_id string, item_no int, kind string, text string, status string, "
    "category string, target string, rationale string, priority string, "
    "dependencies array<string>, method string"
)
PROJECTS = (
    "project_id string, name string, common_identity string, common_dir string, created_at timestamp"
)
WORKTREES = (
    "worktree_id string, project_id string, identity string, path string, active boolean"
)
OBSERVATION_DATA = (
    "struct<path:string,common_dir:string,git_dir:string,common_identity:string,"
    "worktree_identity:string,branch:string,head:string,"
    "status:array<struct<code:string,path:string,original_path:string>>,"
    "commits:array<struct<revision:string,author_time:string,committer_time:string,subject:string>>,"
    "worktrees:array<struct<path:string,head:string>>,available:boolean,diagnostics:array<string>>"
)
OBSERVATIONS = (
    "observation_id long, project_id string, worktree_id string, observed_at timestamp, data "
    + OBSERVATION_DATA
)
CORRECTIONS = (
    "correction_id string, target string, text string, status string, reason string, created_at timestamp"
)
ASSOCIATIONS = (
    "association_id string, target string, project_id string, worktree_id string, reason string, created_at timestamp"
)
FORGOTTEN = ("provider string, session_native_id string, created_at timestamp")
MEMORY = (
    "memory_id string, kind string, text string, status string, origin string, scope string, "
    "refs array<string>, reason string, created_at timestamp, updated_at timestamp, "
    "supersedes string, exceptions string, conflicts string"
)
AUDIT = ("action string, target string, at timestamp, details string")
ACTIVITY = (
    "activity_id long, at timestamp, surface string, tool string, summary string, status string, duration_ms long"
)


def metadata(**given: Column) -> Column:
    """The metadata struct with the given fields set and the others NULL."""
    unknown = set(given) - set(METADATA_FIELDS)
    if unknown:
        raise ValueError(f"unknown metadata fields: {sorted(unknown)}")
    return F.struct(
        *[
            given.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in METADATA_FIELDS.items()
        ]
    )


def fields(table: str) -> list[StructField]:
    """The columns of a table's DDL."""
    return StructType.fromDDL(table).fields
