"""What a refresh keeps: offsets, contexts, whole texts; and rebuilds and exclusions from them."""

import json
import os
import random

from worklore import schema
from worklore.functions import patterns as P
from worklore.operators import normalize
from worklore.plans import refresh
from worklore.sources import ranges, transcripts
from test_ingest import header, put, said, stats


def test_lines_from_any_offset_over_any_chunks(spark, tmp_path):
    rng = random.Random(5)
    lines = ["x" * rng.choice([0, 1, 5, 30, 200]) + "é" * rng.choice([0, 3]) for _ in range(120)]
    raw = ("\n".join(lines)).encode()
    path = f"{tmp_path}/a.jsonl"
    open(path, "wb").write(raw)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)
    for size in (7, 64, 100_000):
        for known in (0, 1, 40, 119):
            files = spark.createDataFrame([(path, starts[known], len(raw))], "source_path string, seen long, length long")
            chunks = ranges.measured(ranges.chunked(files, size)).cache()
            end = ranges.marks(chunks).first()
            assert (end.byte_offset, end.lines, end.later) == (starts[119], 119, 119 - known)
            due = spark.createDataFrame([(path, starts[known], known)], "source_path string, from_offset long, from_line long")
            rows = sorted(ranges.read_lines(chunks, due).collect(), key=lambda r: r.line_no)
            assert [(r.line_no, r.byte_offset, r.value) for r in rows] == [(i + 1, starts[i], lines[i]) for i in range(known, 120)]
            assert [r.tail for r in rows] == [False] * (119 - known) + [True]


def test_prefixes_are_told_by_their_bytes(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"

    def end(text, seen, length=None):
        open(path, "w").write(text)
        files = spark.createDataFrame([(path, seen, length or len(text))], "source_path string, seen long, length long")
        return ranges.marks(ranges.measured(ranges.chunked(files, 10))).first()

    first = end("one line\nand a second\nhal", 0)
    assert first.byte_offset == 22 and first.seen_hash is None and first.error is None
    grown = end("one line\nand a second\nhalf\nmore\n", 22)
    assert grown.seen_hash == first.prefix_hash and (grown.lines, grown.later) == (4, 2)
    assert end("one line\nand A second\nhalf\nmore\n", 22).seen_hash != first.prefix_hash
    assert end("short\n", 0, 60).error == "file is shorter than listed"


def test_messages_carry_their_context(spark, tmp_path):
    first = [{"sessionId": "s", "agentId": "k", "cwd": "/w", "type": "user", "uuid": "1", "message": {"role": "user", "content": "a"}}]
    later = [{"type": "user", "uuid": "2", "message": {"role": "user", "content": "b"}}]
    for name, rows in (("one", first), ("two", later), ("all", first + later)):
        put(f"{tmp_path}/{name}/a.jsonl", rows)
    parsed = {n: transcripts.parse_lines(transcripts.read_transcripts(spark, f"{tmp_path}/{n}")).cache() for n in ("one", "two", "all")}
    known = normalize.contexts(P.PROVIDER_MESSAGES, parsed["one"]).collect()
    prior = spark.createDataFrame([(parsed["two"].first().source_path, known[0].context)], f"source_path string, context {normalize.CONTEXT}")
    got = normalize.normalize(P.PROVIDER_MESSAGES, parsed["two"], prior).first()
    want = [r for r in normalize.normalize(P.PROVIDER_MESSAGES, parsed["all"]).collect() if r.line_no == 2][0]
    assert got.code is None and got.record == want.record and got.record.session_native_id == "s/agent:k"


def test_append_rebuild_and_exclude(spark, tmp_path):
    import zstandard

    trees = spark.createDataFrame([("w1", "p1", "id1", "/w/a", True), ("w2", "p1", "id2", "/w/b", True)], schema.WORKTREES)
    world = refresh.Inputs(transcripts=[("codex", [f"{tmp_path}/src"])], worktrees=trees, chunk_bytes=500)
    root, path = f"{tmp_path}/store", f"{tmp_path}/src/one.jsonl"
    turn = {"type": "turn_context", "payload": {"cwd": "/w/b"}}
    first = [header(), said("user", "word " * 1500 + "\nTASK: far behind the excerpt", 1), turn]
    put(path, first)
    packed = "".join(json.dumps(x) + "\n" for x in [header("s2"), said("user", "TASK: packed", 7)])
    open(f"{tmp_path}/src/two.jsonl.zst", "wb").write(zstandard.ZstdCompressor().compress(packed.encode()))
    refresh.refresh(spark, root, world)
    store = refresh.Store(spark, root)
    assert sorted(r.text for r in store.table("items").collect()) == ["far behind the excerpt", "packed"]
    assert store.table("texts").count() == 1
    assert any(r.full_text.endswith("far behind the excerpt") for r in store.full_records().collect())

    put(path, [*first, said("user", "TASK: later", 3)])
    s = stats(refresh.refresh(spark, root, world))
    assert (s["parsed"], s["inserted"], s["unchanged"], s["failed"]) == (1, 1, 1, 0)
    record = [r for r in store.table("records").collect() if r.native_id == "m3"][0]
    assert (record.session_native_id, record.worktree_id, record.cwd) == ("s1", "w2", "/w/b")
    assert [r.locator.split("@")[0] for r in store.table("occurrences").collect() if r.record_id == record.record_id] == ["line:4"]

    before = sorted(r.item_id for r in store.table("items").collect())
    for name in ("one.jsonl", "two.jsonl.zst"):
        os.remove(f"{tmp_path}/src/{name}")
    world.exclusions = ("*/two.jsonl.zst",)
    s = stats(refresh.refresh(spark, root, world, rebuild=True))
    assert (s["missing"], s["excluded"], s["parsed"]) == (1, 1, 0)
    assert sorted(r.item_id for r in store.table("items").collect()) == before

    s = stats(refresh.exclude_sources(store, "*/one.jsonl"))
    assert s["excluded"] == 1 and refresh.purge(store) >= 3
    assert [r.text for r in store.table("items").collect()] == ["packed"] and store.table("texts").count() == 0
    assert {r.session_native_id for r in store.table("records").collect()} == {"s2"}
    assert {r.status for r in store.table("sources").collect()} == {"excluded"}
