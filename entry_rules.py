"""Registered queries over single rules: times, escapes, ids, inherited history, observed facts, worktrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

import entry_tables as E
from entry_queries import _framed, query
from worklore.functions import patterns as P, textops, timeops
from worklore.operators import associate, extract, normalize
from worklore.sources import transcripts


@query("""SELECT event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE CAST(round(event_id * 1000.25 * 1000000) AS BIGINT) END AS micros,
  CASE WHEN event_id % 100 = 0 THEN NULL ELSE strftime(make_timestamp(CAST(round(event_id * 1000.25 * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso FROM events""")
def epoch_times(spark, sf_dir):
    """Seconds since the epoch as times; those beyond the calendar are unknown."""
    e = E.table(spark, sf_dir, "events").select("event_id")
    seconds = F.when(F.col("event_id") % 100 == 0, F.lit(1e13)).otherwise(F.col("event_id") * F.lit(1000.25))
    at = timeops.epoch_time(seconds)
    return e.select("event_id", F.unix_micros(at).alias("micros"), timeops.iso_utc(at).alias("iso"))


@query(r"""SELECT doc_id, sha256(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ↵ '), chr(13), ''),
  '([\\`*_{}\[\]()#+!|])', '\\\1', 'g')) AS escaped FROM documents""")
def markdown_escapes(spark, sf_dir):
    d = E.spread(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(textops.markdown_escape(F.col("text")), 256).alias("escaped"))


_ITEM = ["record_id", "item_no", "kind", "text", "status", "category", "target", "rationale", "priority", "'[]'", "method"]


@query(f"SELECT record_id, {_framed(*_ITEM)} AS item_id FROM ({E.for_check(E.ITEMS)}) i")
def item_ids(spark, sf_dir):
    """Identity of an item over all that it says."""
    return E.items(spark, sf_dir).select("record_id", extract.item_identity().alias("item_id"))


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines (source_path, line_no, value) as a scan of whole files gives them."""
    return transcripts.parse_lines(
        lines.select(
            "source_path", F.lit(0).cast("long").alias("block"), F.col("line_no").cast("long").alias("line_no"), "value",
            F.concat(F.lit("line:"), F.col("line_no").cast("string")).alias("locator"), F.lit(False).alias("tail"),
        )
    )


def _rollout(events: DataFrame, payload: Column, header: Column) -> DataFrame:
    """One rollout per user: a header and one response item per event, numbered by event."""
    path = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_path")
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("event_id").alias("ordinal"), payload.alias("payload")))
    heads = events.select("user_id").distinct().select(
        path, F.lit(1).alias("line_no"), F.to_json(F.struct(F.lit("session_meta").alias("type"), header.alias("payload"))).alias("value")
    )
    return _parsed(events.select(path, (F.col("event_id") + 2).alias("line_no"), item.alias("value")).unionByName(heads))


def _session_of_user() -> Column:
    return F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id")


@query("""SELECT 's' || user_id AS session, 'm' || event_id AS native_id FROM events WHERE event_id >= user_id * 20
 UNION ALL SELECT DISTINCT 's' || user_id, 'line:1' FROM events""")
def inherited_prefix(spark, sf_dir):
    """History that a session took over from its parent (ordinals before its own start) is left out."""
    e = E.spread(spark, sf_dir, "events")
    said = F.struct(
        F.lit("message").alias("type"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.lit("user").alias("role"), F.lit("x").alias("content")
    )
    header = F.struct(_session_of_user(), (F.col("user_id") * 20).alias("subagent_history_start_ordinal"))
    r = F.col("record")
    return normalize.normalize_rollout(_rollout(e, said, header)).filter("code is null").select(
        r["session_native_id"].alias("session"), r["native_id"].alias("native_id")
    )


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ls ' || event_id WHEN 1 THEN '["ls","' || event_id || '"]' END AS command,
  CASE WHEN event_id % 3 = 1 THEN 'ls ' || event_id END AS words, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_id % 7 END AS exit_status,
  'r' || event_id AS revision, CASE WHEN event_id % 2 = 0 THEN 'b' || user_id END AS branch, event_id % 5 = 0 AS dirty, 'run' AS tool FROM events""")
def observed_metadata(spark, sf_dir):
    """Facts of an execution from the arguments of calls, under each of their names."""
    e = E.spread(spark, sf_dir, "events")
    n, kind = F.col("event_id").cast("string"), F.col("event_id")
    one = lambda condition, value: F.when(condition, value)
    arguments = F.to_json(
        F.struct(
            one(kind % 3 == 0, F.concat(F.lit("ls "), n)).alias("cmd"), one(kind % 3 == 1, F.array(F.lit("ls"), n)).alias("command"),
            one(kind % 4 == 1, kind % 7).alias("exit_code"), one(kind % 4 == 2, kind % 7).alias("exitCode"), one(kind % 4 == 3, kind % 7).alias("exit_status"),
            one(kind % 3 == 0, F.concat(F.lit("r"), n)).alias("revision"), one(kind % 3 == 1, F.concat(F.lit("r"), n)).alias("commit_hash"),
            one(kind % 3 == 2, F.concat(F.lit("r"), n)).alias("sha"),
            one(kind % 2 == 0, F.concat(F.lit("b"), F.col("user_id").cast("string"))).alias("branch"), (kind % 5 == 0).alias("dirty"),
        )
    )
    call = F.struct(F.lit("function_call").alias("type"), F.lit("run").alias("name"), n.alias("call_id"), arguments.alias("arguments"))
    m = F.col("record.metadata")
    found = normalize.normalize_rollout(_rollout(e, call, F.struct(_session_of_user()))).filter(F.col("record.kind") == "agent_proposal")
    return found.select(
        m["call_id"].cast("long").alias("event_id"), m["command"].alias("command"), F.array_join(m["command_argv"], " ").alias("words"),
        m["exit_status"].alias("exit_status"), m["revision"].alias("revision"), m["branch"].alias("branch"), m["dirty"].alias("dirty"), m["tool"].alias("tool"),
    )


@query(f"""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'p0' WHEN user_id % 5 <> 0 AND user_id % 3 = 0 THEN 'p1' END AS project_id,
  CASE WHEN user_id % 2 = 0 THEN '{P.EXPLICIT_REASON}' WHEN user_id % 5 = 0 THEN '{P.EXPLICIT_REASON}'
   WHEN user_id % 3 = 0 THEN 'recorded_cwd_registered_worktree' ELSE 'unregistered_working_context' END AS association_reason FROM events""")
def reassociated_records(spark, sf_dir):
    """Records without a project are tried again with the worktrees known now; explicit choices stay."""
    e = E.spread(spark, sf_dir, "events")
    user = F.col("user_id")
    path = F.concat(F.lit("/u/"), user.cast("string"))
    records = e.select(
        "event_id", F.col("event_id").cast("string").alias("record_id"), F.lit("s").alias("session_id"), F.concat(path, F.lit("/src")).alias("cwd"),
        F.when(user % 2 == 0, "p0").alias("project_id"), F.lit(None).cast("string").alias("worktree_id"),
        F.when((user % 2 == 0) | (user % 5 == 0), P.EXPLICIT_REASON).otherwise("unregistered_working_context").alias("association_reason"),
    )
    trees = e.filter(user % 3 == 0).select(
        F.concat(F.lit("w"), user.cast("string")).alias("worktree_id"), F.lit("p1").alias("project_id"), path.alias("identity"), path.alias("path"), F.lit(True).alias("active")
    ).distinct()
    return associate.reassociate(records, trees).select("event_id", "project_id", "association_reason")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id DESC) AS r FROM events)
 SELECT CASE WHEN user_id % 2 = 0 THEN 'w' || user_id ELSE {_framed("'worktree'", "'p'", "('id' || user_id)")} END AS worktree_id,
  'id' || user_id AS identity, '/p/' || user_id || '/' || event_id % 3 AS path, event_type <> 'error' AS active FROM n WHERE r = 1""")
def upserted_worktrees(spark, sf_dir):
    """Every event observes its user's worktree; half of them are registered, at an older path."""
    e = E.spread(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    identity = F.concat(F.lit("id"), user)
    trees = e.filter("user_id % 2 = 0").select(
        F.concat(F.lit("w"), user).alias("worktree_id"), F.lit("p").alias("project_id"), identity.alias("identity"),
        F.concat(F.lit("/old/"), user).alias("path"), F.lit(True).alias("active"),
    ).distinct()
    place = F.concat(F.lit("/p/"), user, F.lit("/"), (F.col("event_id") % 3).cast("string"))
    observations = e.select(
        F.col("event_id").alias("observation_id"), F.lit("p").alias("project_id"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.struct(identity.alias("worktree_identity"), place.alias("path"), (F.col("event_type") != "error").alias("available")).alias("data"),
    )
    after, _ = associate.upsert_worktrees(trees, observations)
    return after.select("worktree_id", "identity", "path", "active")


def _probe_format(parsed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A format of its own: {"probe": number}; other objects are unknown."""
    number = F.try_variant_get("body", "$.probe", "bigint").cast("string")
    values = {
        "provider": F.lit("probe"), "session_native_id": F.col("source_path"), "native_id": number, "actor": F.lit("tool"),
        "kind": F.lit("recorded_tool_result"), "full_text": F.concat(F.lit("Probe "), number),
    }
    from worklore import schema

    none = F.lit(None).cast("string")
    fields = [(schema.metadata() if n == "metadata" else values.get(n, none)).alias(n) for n in normalize.RECORD_FIELDS]
    code = F.coalesce("code", F.when(number.isNull(), "unknown_format"))
    return parsed.select("source_path", "line_no", "locator", F.when(code.isNull(), F.struct(*fields)).alias("record"), code.alias("code"), none.alias("message"))


@query("""SELECT event_id + 2 AS line_no, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Probe ' || event_id END AS text,
  CASE WHEN event_id % 9 = 0 THEN 'unknown_format' END AS code FROM events""")
def registered_format(spark, sf_dir):
    """A normaliser that is registered at run time takes part like the built-in ones."""
    normalize.register("probe", _probe_format)
    e = E.table(spark, sf_dir, "events")
    value = F.to_json(F.struct(F.when(F.col("event_id") % 9 != 0, F.col("event_id")).alias("probe")))
    lines = e.select(F.lit("f").alias("source_path"), (F.col("event_id") + 2).alias("line_no"), value.alias("value"))
    return normalize.normalize("probe", _parsed(lines)).select("line_no", F.col("record.full_text").alias("text"), "code")
