import json
import os

import pytest
from pyspark.sql import functions as F

from worklore import schema
from worklore.operators import normalize
from worklore.plans import refresh
from worklore.sources import chatstore, docfiles, transcripts


def put(path, lines, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write("".join(json.dumps(x) + "\n" if not isinstance(x, str) else x + "\n" for x in lines) + tail)


def header(sid="s1", cwd="/w/a", **extra):
    return {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": sid, "cwd": cwd, **extra}}


def said(role, text, i, ordinal=None):
    row = {
        "timestamp": f"2026-01-01T00:00:{i:02d}Z", "type": "response_item",
        "payload": {"type": "message", "id": f"m{i}", "role": role, "content": [{"type": "input_text", "text": text}]},
    }
    return row if ordinal is None else {**row, "ordinal": ordinal}


def parsed(spark, path):
    return transcripts.parse_lines(transcripts.read_transcripts(spark, str(path)))


def test_rollout_branches(spark, tmp_path):
    put(
        f"{tmp_path}/a.jsonl",
        [
            said("user", "too early", 1),
            header(subagent_history_start_ordinal=5, git={"branch": "main"}),
            said("user", "inherited", 2, ordinal=3),
            header("other"),
            said("assistant", "hello", 3, ordinal=6),
            {"type": "turn_context", "payload": {"cwd": "/w/b"}},
            {"type": "response_item", "payload": {"type": "function_call", "name": "terminal", "call_id": "c", "arguments": '{"cmd": "ls"}'}},
            {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": [{"type": "output_text", "text": "x"}, "y"]}},
            {"type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "9", "type": "CommandExecution", "command": ["mv", "/w/a", "/w/z"], "cwd": "/w/c", "exit_code": 0, "aggregated_output": "ok"}}},
            {"type": "event_msg", "payload": {"type": "task_complete"}},
            {"type": "event_msg", "payload": {"type": "nobody_knows"}},
            {"type": "mystery", "payload": {}},
            "[1, 2]", "{broken", "",
        ],
        tail='{"type": "half',
    )
    events = normalize.normalize_rollout(parsed(spark, tmp_path)).cache()
    rows = {r.line_no: r for r in events.collect()}
    codes = {n: r.code for n, r in rows.items() if r.code}
    assert codes == {1: "missing_header", 11: "unknown_event", 12: "unknown_event", 13: "malformed_record", 14: "malformed_record", 16: "incomplete_tail"}
    assert 3 not in rows and 4 not in rows
    rec = {n: r.record for n, r in rows.items() if r.record}
    assert (rec[2].actor, rec[2].kind, rec[2].session_native_id, rec[2].metadata.branch) == ("system", "metadata", "s1", "main")
    assert (rec[5].kind, rec[5].full_text, rec[5].cwd, rec[5].native_id) == ("agent_claim", "hello", "/w/a", "m3")
    assert (rec[7].kind, rec[7].full_text, rec[7].metadata.command, rec[7].metadata.tool, rec[7].cwd) == (
        "agent_proposal", '{"cmd": "ls"}', "ls", "terminal", "/w/b")
    assert (rec[8].kind, rec[8].full_text) == ("recorded_tool_result", "x\ny")
    assert (rec[9].native_id, rec[9].cwd, rec[9].metadata.exit_status, rec[9].metadata.execution_source, rec[9].metadata.context_cwd) == (
        "completed:9", "/w/c", 0, "native_command_execution", "/w/b")
    assert list(rec[9].metadata.command_argv) == ["mv", "/w/a", "/w/z"]
    assert rec[10].metadata.event_type == "task_complete"


def test_message_blocks(spark, tmp_path):
    base = {"sessionId": "s", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z"}
    put(
        f"{tmp_path}/b.jsonl",
        [
            {"type": "summary"},
            {**base, "type": "user", "uuid": "u1", "message": {"role": "user", "content": "plain"}},
            {**base, "type": "assistant", "uuid": "u2", "agentId": "k", "message": {"role": "assistant", "content": [
                {"type": "text", "text": "said"}, {"type": "thinking"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}, {"type": "odd"}]}},
            {"type": "user", "uuid": "u3", "toolUseResult": {"exitCode": 2}, "message": {"role": "user", "content": [
                {"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "out"}]}]}},
            {**base, "type": "user", "uuid": "u4", "isMeta": True, "message": {"role": "user", "content": "hidden"}},
            {**base, "type": "system", "uuid": "u5"},
        ],
    )
    rows = normalize.normalize_messages(parsed(spark, tmp_path)).collect()
    assert sorted((r.line_no, r.code) for r in rows if r.code) == [(1, "missing_identity"), (3, "unknown_content")]
    rec = {r.record.native_id: r.record for r in rows if r.record}
    assert set(rec) == {"u1:block:0", "u2:block:0", "u2:block:1", "u2:block:2", "u3:block:0", "u4:block:0", "u5"}
    assert rec["u1:block:0"].full_text == "plain" and rec["u1:block:0"].kind == "user_intent"
    assert rec["u2:block:0"].session_native_id == "s/agent:k"
    assert rec["u2:block:1"].kind == "metadata" and rec["u2:block:2"].metadata.command == "ls"
    got = rec["u3:block:0"]
    assert (got.actor, got.full_text, got.metadata.exit_status, got.metadata.is_error, got.cwd) == ("tool", "out", 2, True, "/w")
    assert rec["u4:block:0"].kind == "metadata" and rec["u5"].metadata.event_type == "system"


def test_chat_store(spark):
    sessions = spark.createDataFrame([("s", 0.0, "/w")], "id string, started_at double, cwd string")
    cols = "id long, session_id string, role string, content string, timestamp double, tool_calls string, tool_call_id string, tool_name string, active int, compacted int"
    call = json.dumps([{"id": "c1", "function": {"name": "run", "arguments": '{"cmd": "ls"}'}}, {"x": 1}])
    rows = [
        (1, "s", "user", "same", 5.0, None, None, None, 0, 1),
        (2, "s", "user", "same", 5.0, None, None, None, 1, 0),
        (3, "s", "user", "rewound", 6.0, None, None, None, 0, 0),
        (4, "s", "assistant", '\0json:[{"type":"text","text":"hi"}]', 4.0, call, None, None, 1, 0),
        (5, "s", "tool", '{"exit_code": 3}', None, "nope", None, "run", 1, 0),
        (6, "s", "alien", "x", 1.0, None, None, None, 1, 0),
    ]
    events = normalize.normalize_chat(chatstore.read_message_store(sessions, spark.createDataFrame(rows, cols)))
    got = events.collect()
    rec = {r.record.native_id: r.record for r in got if r.record}
    assert set(rec) == {"2", "4", "5", "4:call:0"}
    assert rec["4"].full_text == "hi" and rec["4:call:0"].metadata.command == "ls"
    assert rec["5"].metadata.exit_status == 3 and rec["2"].original_time == "1970-01-01T00:00:05.000000Z"
    assert sorted(r.code for r in got if r.code) == ["invalid_timestamp", "invalid_tool_call", "invalid_tool_calls", "unknown_role"]


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "x" * (i % 97)}) for i in range(3000)]
    put(f"{tmp_path}/big.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = transcripts.read_transcripts(spark, str(tmp_path)).collect()
        assert len({r.block for r in rows}) > 5
        offset = 0
        for r in sorted(rows, key=lambda r: r.line_no):
            assert json.loads(r.value)["n"] == r.line_no - 1 and r.byte_offset == offset and not r.tail
            offset += len(r.value) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture()
def world(spark, tmp_path):
    trees = spark.createDataFrame([("w1", "p1", "id1", "/w/a", True)], schema.WORKTREES)
    return refresh.Inputs(transcripts=[("codex", [f"{tmp_path}/src"])], worktrees=trees)


def stats(row):
    return dict(row.first()["stats"])


def test_refresh_lifecycle(spark, tmp_path, world):
    root, path = f"{tmp_path}/store", f"{tmp_path}/src/one.jsonl"
    first = [header(), said("user", "TASK: [a-1] Build the probe.", 1), said("user", "PRINCIPLE: keep receipts", 2)]
    put(path, first)
    put(f"{tmp_path}/src/copy.jsonl", first)
    s = stats(refresh.refresh(spark, root, world))
    assert (s["sources"], s["parsed"], s["inserted"]) == (2, 6, 3)
    store = refresh.Store(spark, root)
    assert store.table("occurrences").count() == 6 and store.table("items").count() == 2
    assert {r.project_id for r in store.table("records").collect()} == {"p1"}
    assert store.table("memory").first()["status"] == "proposed"

    s = stats(refresh.refresh(spark, root, world))
    assert (s["unchanged"], s["parsed"], s["inserted"]) == (2, 0, 0)

    put(path, [*first, said("user", "CANCEL: [a-1] no", 3)], tail='{"half')
    s = stats(refresh.refresh(spark, root, world))
    assert (s["parsed"], s["inserted"], s["partial"]) == (1, 1, 1)
    assert {r.number for r in store.table("generations").collect()} == {1}
    assert [r.code for r in store.table("diagnostics").collect()] == ["incomplete_tail"]

    put(path, [header(), said("user", "TASK: something else", 4)])
    s = stats(refresh.refresh(spark, root, world))
    assert s["inserted"] == 1
    states = {(r.source_id, r.number): r.status for r in store.table("generations").collect()}
    assert sorted(states.values()) == ["current", "current", "superseded"]

    os.remove(f"{tmp_path}/src/copy.jsonl")
    row = refresh.refresh(spark, root, world).first()
    assert row["status"] == "partial" and row["stats"]["missing"] == 1
    assert store.table("records").count() == 5

    s = stats(refresh.refresh(spark, root, world, rebuild=True))
    assert s["inserted"] == 0 and s["items_base"] == 6
    assert store.table("items").count() == 4


def test_refresh_documents_and_chat(spark, tmp_path, world):
    base = f"{tmp_path}/tree"
    os.makedirs(f"{base}/docs")
    os.makedirs(f"{base}/logs")
    open(f"{base}/README.md", "w").write("# Probe\n\nProbe keeps receipts.\n")
    open(f"{base}/docs/STATUS.md", "w").write("## Pending\n\n- Verify the export.\n")
    open(f"{base}/docs/verification.txt", "wb").write(b"bad\x00bytes")
    open(f"{base}/logs/README.md", "w").write("private")
    open(f"{base}/notes.md", "w").write("not selected")
    documents = docfiles.read_documents(spark, base, "p1", "w1")
    assert {(r.relative_path, r.code) for r in documents.collect()} == {
        ("README.md", None), ("docs/STATUS.md", None), ("docs/verification.txt", "document_binary_unsupported")}
    put(f"{tmp_path}/src/one.jsonl", [header()])
    sessions = spark.createDataFrame([("s", 0.0)], "id string, started_at double")
    messages = spark.createDataFrame([(1, "s", "user", "TASK: chat work", 1.0)], "id long, session_id string, role string, content string, timestamp double")
    world.documents, world.chat = documents, (sessions, messages)
    root = f"{tmp_path}/store"
    refresh.refresh(spark, root, world)
    store = refresh.Store(spark, root)
    got = {(r.kind, r.category) for r in store.table("items").collect()}
    assert ("task", "documented_pending") in got and ("purpose", "documented_purpose") in got and ("task", "user_intent") in got
    open(f"{base}/docs/STATUS.md", "w").write("## Pending\n\n- Verify the import.\n")
    world.documents = docfiles.read_documents(spark, base, "p1", "w1")
    s = stats(refresh.refresh(spark, root, world))
    assert s["inserted"] == 1


def test_compressed_transcripts(spark, tmp_path):
    import zstandard

    text = "".join(json.dumps(x) + "\n" for x in [header(), said("user", "TASK: a", 1)])
    open(f"{tmp_path}/a.jsonl.zst", "wb").write(zstandard.ZstdCompressor().compress(text.encode()))
    rows = transcripts.read_transcripts(spark, str(tmp_path), compressed=True).orderBy("line_no").collect()
    assert [r.locator for r in rows] == ["decompressed-line:1", "decompressed-line:2"]
    assert json.loads(rows[0].value)["payload"]["id"] == "s1"
