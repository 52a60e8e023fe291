"""Producer envelopes -> one record schema.

Each normaliser returns rows of (source_path, line_no, locator, record, code,
message).  `record` is NULL on pure diagnostics; a row may carry both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.plans import settle
from ..functions import hashing, jsonops as J, ordering, patterns as P, textops, timeops

RECORD_FIELDS = [
    "provider", "session_native_id", "native_id", "actor", "kind", "full_text",
    "original_time", "cwd", "metadata",
]


def _null() -> Column:
    return F.lit(None).cast("string")


def _choose(branches: list[tuple[Column, Column]]) -> Column:
    out = F.when(branches[0][0], branches[0][1])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out


def _record(**fields: Column) -> Column:
    return F.struct(*[fields[name].alias(name) for name in RECORD_FIELDS])


def _emit(df: DataFrame, record: Column, code: Column, message: Column | None = None) -> DataFrame:
    emitted = df.select(
        "source_path", "line_no", "locator",
        record.alias("record"), code.alias("code"),
        (_null() if message is None else message).alias("message"),
    )
    return settle(emitted).filter(F.col("record").isNotNull() | F.col("code").isNotNull())


CONTEXT = "struct<session:string,line:bigint,boundary:bigint,agent:string,cwd:string>"


def _with_context(lines: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Adds `before`, the context carried into each source (source_path, context); null where there is none."""
    if prior is None:
        return lines.withColumn("before", F.lit(None).cast(CONTEXT))
    known = prior.select(F.col("source_path").alias("_known"), F.col("context").cast(CONTEXT).alias("before"))
    return lines.join(known, lines.source_path == known._known, "left").drop("_known")


def _rollout_lines(parsed: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Lines with their source's header (`head`) and, where a line sets it, context_cwd."""
    v, p = F.col("body"), F.col("payload")
    base = parsed.select(
        "source_path", "block", "line_no", "locator", "code", "body",
        J.string_at(v, "$.type").alias("outer"),
        J.node(v, "$.payload").alias("payload"),
        J.string_at(v, "$.timestamp").alias("original_time"),
        J.int_at(v, "$.ordinal").alias("ordinal"),
        J.string_at(v, "$.cwd").alias("event_cwd"),
    ).withColumns(
        {
            "shaped": J.is_object(p) & F.col("outer").isNotNull(),
            "inner": J.string_at(p, "$.type"),
            "item": J.node(p, "$.item"),
            "payload_id": J.string_at(p, "$.id"),
            "payload_cwd": J.string_at(p, "$.cwd"),
        }
    ).withColumn("item_ok", J.is_object(F.col("item")))
    is_header = F.col("shaped") & (F.col("outer") == "session_meta")
    valid_header = is_header & (F.coalesce(F.col("payload_id"), F.lit("")) != "")
    heads = (
        base.filter(valid_header)
        .groupBy(F.col("source_path").alias("_path"))
        .agg(
            F.min_by(
                F.struct(
                    F.col("payload_id").alias("session"),
                    F.col("line_no").alias("line"),
                    F.coalesce(
                        J.int_at(p, "$.subagent_history_start_ordinal"), F.lit(0)
                    ).cast("long").alias("boundary"),
                ),
                "line_no",
            ).alias("_own")
        )
    )
    joined = _with_context(base.join(heads, base.source_path == heads._path, "left").drop("_path"), prior)
    earlier = F.when(F.col("before.session").isNotNull(), F.struct("before.session", "before.line", "before.boundary"))
    joined = joined.withColumn("head", F.coalesce(earlier, "_own")).drop("_own")
    started = F.coalesce(F.col("line_no") >= F.col("head.line"), F.lit(False))
    inherited = (
        ~is_header & F.coalesce(F.col("ordinal") < F.col("head.boundary"), F.lit(False))
    )
    own_header = F.coalesce(F.col("line_no") == F.col("head.line"), F.lit(False))
    context = F.when(
        own_header | (F.col("outer") == "turn_context") & started & ~inherited & F.col("shaped"),
        F.col("payload_cwd"),
    )
    dropped = (is_header & valid_header & ~own_header) | (started & inherited)
    return joined.withColumns(
        {"context_cwd": context, "is_header": is_header, "valid_header": valid_header, "started": started, "_dropped": dropped}
    )


def normalize_rollout(parsed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Rollout envelopes: `type` x `payload.type`, context carried through the file.

    prior (source_path, context): what `contexts` gave for the lines before these.
    """
    v, p = F.col("body"), F.col("payload")
    carried = ordering.carry_forward(
        _rollout_lines(parsed, prior), ["source_path"], "block", "line_no", ["context_cwd"],
    ).filter(~F.col("_dropped")).withColumn("context_cwd", F.coalesce("context_cwd", "before.cwd"))
    is_header, valid_header, started = F.col("is_header"), F.col("valid_header"), F.col("started")

    outer, inner = F.col("outer"), F.col("inner")
    response, event = outer == "response_item", outer == "event_msg"
    role = J.string_at(p, "$.role")
    message = response & (inner == "message")
    agent = response & (inner == "agent_message")
    call = response & inner.isin(P.ROLLOUT_TOOL_CALLS)
    output = response & inner.isin(P.ROLLOUT_TOOL_OUTPUTS)
    silent = response & inner.isin(P.ROLLOUT_SILENT_ITEMS)
    completed = event & (inner == "item_completed")
    item_type = J.string_at(F.col("item"), "$.type")
    item_seen = J.observed(F.col("item"))
    plain_item = completed & F.col("item_ok")
    result = plain_item & F.coalesce(
        item_seen["exit_status"].isNotNull()
        | item_seen["command"].isNotNull()
        | F.coalesce(item_type.isin(P.ROLLOUT_RESULT_ITEMS), F.lit(False)),
        F.lit(False),
    )
    noted = event & inner.isin(P.ROLLOUT_EVENTS)
    outer_meta = outer.isin(P.ROLLOUT_OUTER_METADATA)

    args = F.coalesce(*[J.node(p, "$." + k) for k in ("arguments", "input", "action")])
    item_text = F.coalesce(*[J.node(F.col("item"), "$." + k) for k in P.ROLLOUT_RESULT_FIELDS])
    line_id = F.concat(F.lit("line:"), F.col("line_no").cast("string"))
    item_id = J.string_at(F.col("item"), "$.id")

    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(~F.col("shaped"), "unknown_format")
        .when(is_header & ~valid_header, "invalid_identity")
        .when(is_header, F.when(J.truthy(p, "$.history_base"), "external_history"))
        .when(~started, "missing_header")
        .when(message, F.when(~F.coalesce(role.isin(P.ROLLOUT_ROLES), F.lit(False)), "unknown_role"))
        .when(
            agent,
            F.when(
                F.exists(
                    F.coalesce(
                        F.try_variant_get(p, "$.content", "array<variant>"),
                        F.array().cast("array<variant>"),
                    ),
                    lambda x: F.coalesce(
                        J.string_at(x, "$.type") == "encrypted_content", F.lit(False)
                    ),
                ),
                "opaque_content",
            ),
        )
        .when(completed & ~F.col("item_ok"), "invalid_record")
        .when(call | output | silent | plain_item | noted | outer_meta | (outer == "turn_context"), _null())
        .otherwise("unknown_event")
    )
    # The branch a row takes is decided once; every field below only looks it up.
    branch = (
        F.when(message, F.when(role == "user", "user").when(role == "assistant", "assistant").otherwise("other"))
        .when(agent, "agent").when(call, "call").when(output, "output").when(silent, "silent")
        .when(result, "result").when(plain_item, "item").when(is_header, "header")
        .when(noted, "event").when(outer_meta, "outer").otherwise("context")
    )
    taken = F.col("branch")
    spoken = taken.isin("user", "assistant", "other", "agent")
    is_call, is_output, is_result = taken == "call", taken == "output", taken == "result"
    is_item = taken.isin("item", "result")
    source = (
        F.when(spoken, J.node(p, "$.content")).when(is_call, args)
        .when(is_output, J.node(p, "$.output")).when(is_result, item_text)
    )
    seen_from = (
        F.when(is_call, args).when(is_output, J.node(p, "$.output"))
        .when(is_item, F.col("item")).when(taken == "header", J.node(p, "$.git"))
    )
    coded = (
        carried.withColumns({"branch": branch, "_code": code, "_role": role})
        .withColumns({"_source": source, "_seen": J.as_mapping(seen_from)})
        .withColumn("_text", J.flat_text(F.col("_source")))
    )
    native_command = is_item & item_type.isin(P.ROLLOUT_COMMAND_ITEMS)
    header_text = lambda k: F.when(taken == "header", J.string_at(p, "$." + k))
    meta = schema.metadata(
        **J.observed(F.col("_seen")),
        tool=F.when(is_call, J.string_at(p, "$.name")),
        call_id=F.when(is_call | is_output, J.string_at(p, "$.call_id")),
        phase=F.when(taken.isin("user", "assistant", "other"), J.string_at(p, "$.phase")),
        author=F.when(taken == "agent", J.string_at(p, "$.author")),
        recipient=F.when(taken == "agent", J.string_at(p, "$.recipient")),
        event_type=F.when(taken == "event", inner).when(taken == "outer", outer),
        execution_source=F.when(native_command, "native_command_execution"),
        context_cwd=F.when(native_command, F.col("context_cwd")),
        root_session_id=header_text("session_id"),
        parent_thread_id=header_text("parent_thread_id"),
        forked_from_id=header_text("forked_from_id"),
        cli_version=header_text("cli_version"),
        history_mode=header_text("history_mode"),
        history_base=F.when(taken == "header", F.try_variant_get(p, "$.history_base", "string")),
    )
    record = _record(
        provider=F.lit(P.PROVIDER_ROLLOUT),
        session_native_id=F.col("head.session"),
        native_id=F.when(spoken | is_call | is_output | (taken == "silent"), F.coalesce("payload_id", line_id))
        .when(is_result & item_id.isNotNull(), F.concat(F.lit("completed:"), item_id))
        .otherwise(line_id),
        actor=F.when(taken.isin("user", "assistant", "other"), F.col("_role"))
        .when(taken.isin("agent", "call"), "assistant")
        .when(is_output | is_result, "tool").otherwise("system"),
        kind=F.when(taken == "user", "user_intent").when(taken.isin("assistant", "agent"), "agent_claim")
        .when(is_call, "agent_proposal").when(is_output | is_result, "recorded_tool_result")
        .otherwise("metadata"),
        full_text=F.when(is_call & (F.col("_text") == ""), F.coalesce(F.to_json("_source"), F.lit("")))
        .otherwise(F.col("_text")),
        original_time=F.col("original_time"),
        cwd=F.coalesce(
            F.when(is_item, J.string_at(F.col("item"), "$.cwd")), F.col("event_cwd"), F.col("context_cwd")
        ),
        metadata=meta,
    )
    keep = F.col("_code").isNull() | F.col("_code").isin("external_history", "opaque_content")
    return _emit(coded, F.when(keep, record), F.col("_code"))


def _message_lines(parsed: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Lines with the session, agent and directory that they themselves name, and whether a session was named by then."""
    v = F.col("body")
    named = F.nullif(J.string_at(v, "$.sessionId"), F.lit(""))
    base = parsed.select(
        "source_path", "block", "line_no", "locator", "code", "body",
        named.alias("root_session"),
        F.when(named.isNotNull(), F.nullif(J.string_at(v, "$.agentId"), F.lit(""))).alias("agent"),
        J.string_at(v, "$.cwd").alias("cwd"),
    )
    heads = (
        base.filter("root_session is not null")
        .groupBy(F.col("source_path").alias("_path"))
        .agg(F.min("line_no").alias("_first"))
    )
    joined = _with_context(base.join(heads, base.source_path == heads._path, "left").drop("_path"), prior)
    started = F.col("before.session").isNotNull() | F.coalesce(F.col("line_no") >= F.col("_first"), F.lit(False))
    return joined.withColumn("started", started).withColumn("cwd", F.when(F.col("started"), F.col("cwd")))


def normalize_messages(parsed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Message envelopes: one record per content block.

    prior (source_path, context): what `contexts` gave for the lines before these.
    """
    v = F.col("body")
    carried = ordering.carry_forward(
        _message_lines(parsed, prior), ["source_path"], "block", "line_no", ["root_session", "agent", "cwd"],
    ).withColumns({
        "root_session": F.coalesce("root_session", "before.session"),
        "agent": F.coalesce("agent", "before.agent"), "cwd": F.coalesce("cwd", "before.cwd"),
    })
    started = F.col("started")
    message = J.node(v, "$.message")
    shaped = carried.withColumns(
        {
            "type": J.string_at(v, "$.type"),
            "role": J.string_at(message, "$.role"),
            "content": J.node(message, "$.content"),
            "uuid": F.coalesce(
                J.string_at(v, "$.uuid"),
                F.concat(F.lit("line:"), F.col("line_no").cast("string")),
            ),
            "session": F.concat(
                F.col("root_session"),
                F.coalesce(F.concat(F.lit("/agent:"), F.col("agent")), F.lit("")),
            ),
            "aside": F.coalesce(J.string_at(v, "$.type").isin(P.MESSAGE_METADATA_TYPES), F.lit(False)),
        }
    )
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(~started, "missing_identity")
        .when(F.col("aside"), _null())
        .when(
            ~F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False))
            | ~J.is_object(message),
            "unknown_event",
        )
        .when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "unknown_role")
    )
    parts = F.when(
        J.is_array(F.col("content")), F.try_variant_get(F.col("content"), "$", "array<variant>")
    ).otherwise(F.array(F.col("content")))
    single = F.array(F.lit(None).cast("variant"))
    coded = shaped.withColumn("code", code)
    blocks = coded.select(
        "*",
        F.posexplode_outer(
            F.when(F.col("code").isNotNull() | F.col("aside"), single).otherwise(parts)
        ).alias("index", "part"),
    )
    part = F.col("part")
    part_type = J.string_at(part, "$.type")
    branch = (
        F.when(F.col("aside"), "aside")
        .when(J.is_string(part) | (part_type == "text"), "spoken")
        .when(part_type == "tool_use", "use")
        .when(part_type == "tool_result", "returned")
        .when(part_type.isin(P.MESSAGE_SILENT_BLOCKS), "quiet")
        .otherwise("unknown")
    )
    taken = F.col("branch")
    spoken, use, returned, aside = taken == "spoken", taken == "use", taken == "returned", taken == "aside"
    source = F.when(spoken, part).when(returned, J.node(part, "$.content"))
    seen_from = F.when(use, J.node(part, "$.input")).when(returned, J.node(v, "$.toolUseResult"))
    final = (
        blocks.withColumn("branch", branch)
        .withColumns(
            {
                "_code": F.coalesce(F.col("code"), F.when(taken == "unknown", "unknown_content")),
                "_seen": J.as_mapping(seen_from),
                "_text": F.when(use, F.to_json(J.node(part, "$.input"))).otherwise(J.flat_text(source)),
                "_hidden": J.truthy(v, "$.isMeta") | J.truthy(v, "$.isCompactSummary"),
            }
        )
    )
    seen = J.observed(F.col("_seen"))
    seen["branch"] = F.coalesce(seen["branch"], J.string_at(v, "$.gitBranch"))
    meta = schema.metadata(
        **seen,
        tool=F.when(use, J.string_at(part, "$.name")),
        call_id=F.when(use, J.string_at(part, "$.id")).when(returned, J.string_at(part, "$.tool_use_id")),
        is_error=F.when(returned, J.bool_at(part, "$.is_error")),
        event_type=F.when(aside, F.col("type")),
        parent_uuid=J.string_at(v, "$.parentUuid"),
        is_sidechain=J.bool_at(v, "$.isSidechain"),
        agent_id=J.string_at(v, "$.agentId"),
        version=J.string_at(v, "$.version"),
        parent_session_id=F.when(F.col("agent").isNotNull(), F.col("root_session")),
    )
    silent = aside | (taken == "quiet")
    record = _record(
        provider=F.lit(P.PROVIDER_MESSAGES),
        session_native_id=F.col("session"),
        native_id=F.when(aside, F.col("uuid")).otherwise(
            F.concat(F.col("uuid"), F.lit(":block:"), F.col("index").cast("string"))
        ),
        actor=F.when(silent, "system").when(spoken, F.col("role")).when(use, "assistant").otherwise("tool"),
        kind=F.when(silent | (spoken & F.col("_hidden")), "metadata")
        .when(spoken, F.when(F.col("role") == "user", "user_intent").otherwise("agent_claim"))
        .when(use, "agent_proposal").otherwise("recorded_tool_result"),
        full_text=F.coalesce(F.when(~silent, F.col("_text")), F.lit("")),
        original_time=J.string_at(v, "$.timestamp"),
        cwd=F.col("cwd"),
        metadata=meta,
    )
    return _emit(final, F.when(F.col("_code").isNull(), record), F.col("_code"))


def normalize_chat(rows: DataFrame) -> DataFrame:
    """Chat-store rows (see `sources.chatstore`) and their tool calls."""
    content_text = F.col("content")
    coded = content_text.startswith(P.CHAT_JSON_PREFIX)
    decoded = F.try_parse_json(F.substring(content_text, len(P.CHAT_JSON_PREFIX) + 1, 1 << 30))
    role = F.col("role")
    known_role = F.coalesce(role.isin(P.CHAT_ROLES), F.lit(False))
    projected = (F.coalesce(F.col("_compressed_summary"), F.lit(0)) != 0) | (
        F.coalesce(F.col("display_kind"), F.lit("")) != ""
    )
    when_at = timeops.epoch_time(F.col("timestamp"))
    base = rows.select(
        "*",
        F.lit("message_store").alias("source_path"),
        F.col("id").alias("line_no"),
        F.concat(F.lit("messages:"), F.col("id").cast("string")).alias("locator"),
        F.when(coded, decoded).alias("decoded"),
        when_at.alias("at"),
    )
    seen = J.observed(F.col("_seen"))
    seen["branch"] = F.coalesce(seen["branch"], F.col("session_git_branch"))
    shared = dict(
        provider=F.lit(P.PROVIDER_CHAT),
        session_native_id=F.col("session_id").cast("string"),
        original_time=timeops.iso_utc(F.col("at")),
        cwd=F.col("session_cwd"),
    )
    message = _record(
        **shared,
        native_id=F.col("id").cast("string"),
        actor=role,
        kind=_choose(
            [
                (projected, F.lit("metadata")),
                (role == "user", F.lit("user_intent")),
                (role == "assistant", F.lit("agent_claim")),
                (role == "tool", F.lit("recorded_tool_result")),
                (F.lit(True), F.lit("metadata")),
            ]
        ),
        full_text=F.coalesce(
            F.when(F.col("decoded").isNotNull(), J.flat_text(F.col("decoded"))),
            content_text,
            F.lit(""),
        ),
        metadata=schema.metadata(
            **seen,
            call_id=F.col("tool_call_id"),
            tool=F.col("tool_name"),
            git_repo_root=F.col("session_git_repo_root"),
            parent_session_id=F.col("session_parent_session_id"),
            ended_at=F.col("session_ended_at"),
            end_reason=F.col("session_end_reason"),
        ),
    )
    fields = base.withColumn(
        "_seen",
        J.as_mapping(F.when(role == "tool", F.coalesce(F.col("decoded"), J.parse(content_text)))),
    )
    usable = fields.filter(~F.col("_oversized") & known_role)
    messages = _emit(usable, message, _null())
    problems = _emit(
        fields.select(
            "source_path", "line_no", "locator",
            F.explode(
                F.filter(
                    F.array(
                        F.when(F.col("_oversized"), "oversized_record")
                        .when(~known_role, "unknown_role"),
                        F.when(~F.col("_oversized") & known_role & projected, "compaction_projection"),
                        F.when(~F.col("_oversized") & known_role & F.col("at").isNull(), "invalid_timestamp"),
                    ),
                    lambda c: c.isNotNull(),
                )
            ).alias("_code"),
        ),
        F.lit(None).cast(messages.schema["record"].dataType),
        F.col("_code"),
    )
    calls_json = J.parse(F.col("tool_calls"))
    calls = usable.filter(F.coalesce(F.col("tool_calls"), F.lit("")) != "").select(
        "*", calls_json.alias("calls")
    )
    listed = J.is_array(F.col("calls"))
    each = calls.select(
        "*",
        F.posexplode_outer(
            F.when(listed, F.try_variant_get(F.col("calls"), "$", "array<variant>")).otherwise(
                F.array(F.lit(None).cast("variant"))
            )
        ).alias("index", "call"),
    )
    each = each.withColumn("function", J.node(F.col("call"), "$.function")).withColumn(
        "arguments", J.node(F.col("function"), "$.arguments")
    ).withColumn("_args", J.as_mapping(F.col("arguments")))
    function, arguments = F.col("function"), F.col("arguments")
    proposal = _record(
        **shared,
        native_id=F.concat(F.col("id").cast("string"), F.lit(":call:"), F.col("index").cast("string")),
        actor=F.lit("assistant"),
        kind=F.lit("agent_proposal"),
        full_text=F.coalesce(
            F.when(J.is_string(arguments), F.try_variant_get(arguments, "$", "string")),
            F.to_json(arguments),
            F.lit(""),
        ),
        metadata=schema.metadata(
            **J.observed(F.col("_args")),
            tool=J.string_at(function, "$.name"),
            call_id=F.coalesce(
                J.string_at(F.col("call"), "$.id"), J.string_at(F.col("call"), "$.call_id")
            ),
        ),
    )
    call_code = F.when(~listed, "invalid_tool_calls").when(
        ~J.is_object(function), "invalid_tool_call"
    )
    proposals = _emit(each, F.when(call_code.isNull(), proposal), call_code)
    return messages.unionByName(problems).unionByName(proposals)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    P.PROVIDER_ROLLOUT: normalize_rollout,
    P.PROVIDER_MESSAGES: normalize_messages,
}


def register(provider: str, normalizer: Callable[..., DataFrame]) -> None:
    """Extension point: (parsed lines, prior contexts or None) -> (source_path, line_no, locator, record, code, message)."""
    NORMALIZERS[provider] = normalizer


def normalize(provider: str, parsed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    if provider not in NORMALIZERS:
        raise ValueError("unsupported_format")
    return NORMALIZERS[provider](parsed, prior)


def contexts(provider: str, parsed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(source_path, context): what lines appended later need to know of these and of those before them.

    One row per source of parsed; a provider without carried context gives null.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    if provider == P.PROVIDER_ROLLOUT:
        ends = _rollout_lines(parsed, prior).groupBy("source_path").agg(
            F.first("head", ignorenulls=True).alias("h"), last("context_cwd").alias("cwd"), F.first("before").alias("b")
        )
        fields = ["h.session", "h.line", "h.boundary", F.lit(None).cast("string").alias("agent"), F.coalesce("cwd", "b.cwd").alias("cwd")]
    elif provider == P.PROVIDER_MESSAGES:
        ends = _message_lines(parsed, prior).groupBy("source_path").agg(
            last("root_session").alias("session"), last("agent").alias("agent"), last("cwd").alias("cwd"), F.first("before").alias("b")
        )
        none = F.lit(None).cast("long")
        named = {c: F.coalesce(c, "b." + c).alias(c) for c in ("session", "agent", "cwd")}
        fields = [named["session"], none.alias("line"), none.alias("boundary"), named["agent"], named["cwd"]]
    else:
        return parsed.select("source_path", F.lit(None).cast(CONTEXT).alias("context")).distinct()
    return ends.select("source_path", F.struct(*fields).cast(CONTEXT).alias("context"))


def _with_clean_metadata(df: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Redact every text of the metadata; the rules appear once, over an array of the texts."""
    meta = F.col("metadata")
    texts = [name for name, kind in schema.METADATA_FIELDS.items() if kind == "string"]
    mask = lambda x: F.when(x.isNotNull(), textops.redact(x, extra_patterns=extra))
    cleaned = df.withColumns(
        {
            "_texts": F.transform(F.array(*[meta[n] for n in texts]), mask),
            "_argv": F.transform(meta["command_argv"], mask),
        }
    )
    fields = []
    for name in schema.METADATA_FIELDS:
        if name in texts:
            fields.append(F.get("_texts", F.lit(texts.index(name))).alias(name))
        else:
            fields.append((F.col("_argv") if name == "command_argv" else meta[name]).alias(name))
    return cleaned.withColumn("metadata", F.struct(*fields)).drop("_texts", "_argv")


def records_of(
    events: DataFrame, extra_patterns: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Redacted, identified records with their location; one row per occurrence.

    `full_text` feeds hashing and extraction and is dropped at the sink; `text`
    is the stored excerpt.  `keep` names columns of events that rows carry along.
    """
    r = events.filter("record is not null").select(
        "source_path", "line_no", "locator", *keep, "record.*"
    )
    clean = lambda c, limit=P.MAX_EXCERPT: textops.redact(F.col(c), limit, extra_patterns)
    cleaned = r.select(
        "source_path", "line_no", "locator", *keep, "provider",
        clean("session_native_id").alias("session_native_id"),
        clean("native_id").alias("native_id"),
        "actor", "kind",
        clean("full_text", None).alias("full_text"),
        "original_time",
        clean("cwd").alias("cwd"),
        "metadata",
    )
    return with_identity(_with_clean_metadata(cleaned, extra_patterns))


def with_identity(cleaned: DataFrame) -> DataFrame:
    """Add ids, excerpt and event time to redacted records."""
    time = F.col("original_time")
    return settle(cleaned).withColumns(
        {
            "text": textops.truncate(F.col("full_text"), P.MAX_EXCERPT),
            "event_time": timeops.event_time(time),
            "time_status": timeops.time_status(time),
            "session_id": hashing.content_id(F.col("provider"), F.col("session_native_id")),
            "record_id": hashing.content_id(
                *[F.col(c) for c in RECORD_FIELDS if c != "metadata"], F.to_json("metadata")
            ),
        }
    )


def diagnostics_of(events: DataFrame) -> DataFrame:
    return events.filter("code is not null").select(
        "source_path", "line_no", "locator", "code", "message"
    )
