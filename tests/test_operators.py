import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from worklore import schema
from worklore.functions import textops
from worklore.operators import associate, docs, facets, moves, normalize, pack, resolve, search
from worklore.plans import resume
from worklore.sources import transcripts
from worklore.streaming import activity, landing

VIEW = (
    "item_id string, record_id string, item_no int, kind string, text string, status string, category string, "
    "target string, rationale string, priority string, dependencies array<string>, method string, session_id string, "
    "native_id string, project_id string, worktree_id string, provider string, actor string, event_time timestamp, "
    "time_status string, source_current boolean"
)
T0 = dt.datetime(2026, 1, 1)


def item(i, kind, text, record=None, status="active", target=None, at=0, actor="user", project="p", current=True, category="user_intent"):
    when = None if at is None else T0 + dt.timedelta(minutes=at)
    return (f"i{i}", record or f"r{i}", 0, kind, text, status, category, target, None, None, [], "m", "s", f"n{i}", project, "w",
            "codex", actor, when, "known" if when else "missing", current)


def brute_force(rows, topics):
    """Direct reading of the rules: every action against every item."""
    names = VIEW.replace(",", " ").split()[::2]
    items = [dict(zip([n for n in names], r)) for r in rows]
    low = dt.datetime.min
    items.sort(key=lambda x: (x["event_time"] or low, x["item_id"]))
    for x in items:
        x["refs"], x["open"] = 0, False
        if not x["source_current"] and x["status"] in ("active", "pending", "blocked", "proposed"):
            x["status"] = "source_superseded"
    for a in items:
        if a["kind"] != "correction" or not a["target"] or not a["source_current"]:
            continue
        hits = [
            x for x in items
            if x["kind"] != "correction" and (a["target"] in (x["item_id"], x["record_id"], x["native_id"])
            or (x["kind"] in ("task", "next_action", "blocker", "decision") and a["target"] == "text:" + topics[x["item_id"]]))
            and (x["project_id"], x["worktree_id"]) == (a["project_id"], a["worktree_id"]) and a["event_time"]
            and ((x["actor"] == "document" and x["source_current"]) or (x["event_time"] and x["event_time"] <= a["event_time"]))
        ]
        if a["actor"] == "user" and hits and len({x["record_id"] for x in hits}) == 1 and (not a["target"].startswith("text:") or len(hits) == 1):
            for x in hits:
                x["status"], x["refs"] = a["status"], x["refs"] + 1
        else:
            a["open"] = True
    return {x["item_id"]: (x["status"], x["refs"], x["open"]) for x in items}


def test_resolution_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(260):
        if rng.random() < 0.35:
            target = rng.choice([f"n{rng.randrange(260)}", f"r{rng.randrange(90)}", f"i{rng.randrange(260)}", f"text:probe {rng.randrange(8)}", None])
            rows.append(item(i, "correction", "x", f"c{i}", rng.choice(["cancelled", "superseded"]), target, rng.choice([None, *range(60)]), rng.choice(["user", "user", "assistant"]), rng.choice(["p", None]), rng.random() < 0.9))
        else:
            actor = rng.choice(["user", "assistant", "document"])
            at = None if actor == "document" else rng.choice([None, *range(60)])
            # Two of three share one hot topic.
            text = "probe 0" if rng.random() < 0.6 else f"Probe {rng.randrange(8)} is pending."
            rows.append(item(i, rng.choice(["task", "decision", "claim"]), text, f"r{rng.randrange(90)}", "active", None, at, actor, rng.choice(["p", None]), rng.random() < 0.9))
    view = spark.createDataFrame(rows, VIEW)
    topics = {r.item_id: r.t for r in view.select("item_id", textops.topic_key(F.col("text")).alias("t")).collect()}
    none = spark.createDataFrame([], schema.CORRECTIONS)
    got = {r.item_id: (r.status, r.resolutions, r.resolution_uncertainty is not None) for r in resolve.resolve_items(view, none).collect()}
    want = brute_force(rows, topics)
    assert got == want
    refs = resolve.resolution_refs(view, none).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in refs} == {k: v[1] for k, v in want.items() if v[1]}
    assert sum(v[1] for v in want.values()) > 3


def test_explicit_corrections_and_signature_topic(spark):
    rows = [
        item(1, "task", "Verify the release signature", at=1, status="pending"),
        item(2, "correction", "imza iptal", at=2, status="cancelled", target="text:verify:signature"),
        item(3, "task", "other", at=1),
    ]
    fixes = [
        ("k1", "r3", None, "accepted", "x", T0), ("k2", "i3", "reworded", "blocked", "x", T0 + dt.timedelta(hours=1)),
        ("k3", "n1", None, "rejected", "native ids do not count", T0),
    ]
    out = {r.item_id: r for r in resolve.resolve_items(spark.createDataFrame(rows, VIEW), spark.createDataFrame(fixes, schema.CORRECTIONS)).collect()}
    assert out["i1"].status == "cancelled" and out["i1"].authority is None
    assert (out["i3"].status, out["i3"].text, out["i3"].resolutions, out["i3"].authority) == ("blocked", "reworded", 2, "user_correction")


def test_pack_is_the_greedy_walk(spark):
    rng = random.Random(3)
    rows = [("p" if rng.random() < 0.9 else None, i, "x" * rng.choice([5, 40, 200, 900, 2500])) for i in range(400)]
    got = pack.pack(spark.createDataFrame(rows, "project_id string, entry_id int, text string"), 4000, []).collect()
    for project in ("p", None):
        used, kept = 0, []
        for _, i, text in sorted((r for r in rows if r[0] == project), key=lambda r: r[1]):
            if used + len(text) + pack.ENTRY_OVERHEAD <= 3999:
                used += len(text) + pack.ENTRY_OVERHEAD
                kept.append(i)
        assert [r.entry_id for r in sorted((r for r in got if r.project_id == project), key=lambda r: r.position)] == kept


def test_directories_and_worktree_upsert(spark):
    trees = spark.createDataFrame([("w1", "p1", "id1", "/r/a", True), ("w2", "p1", "id2", "/r/a/sub", True)], schema.WORKTREES)
    cwds = spark.createDataFrame([("/r/a/sub/x",), ("/r/a/b",), ("/r/ab",), ("rel",), ("",), (None,), ("file:///r/a",)], "cwd string")
    rec = cwds.withColumn("record_id", F.monotonically_increasing_id().cast("string")).withColumn("session_id", F.lit("s"))
    got = {r.cwd: (r.worktree_id, r.association_reason) for r in associate.associate(rec, trees).collect()}
    assert got["/r/a/sub/x"] == ("w2", "recorded_cwd_registered_worktree") and got["/r/a/b"][0] == "w1"
    assert got["/r/ab"] == (None, "unregistered_working_context") and got["rel"][1] == "relative_working_context"
    assert got[""][1] == got[None][1] == "missing_working_context" and got["file:///r/a"][0] == "w1"
    data = lambda path, ident: (path, None, None, "c", ident, "main", "h", [], [], [], True, [])
    obs = spark.createDataFrame(
        [(1, "p1", None, T0, data("/moved", "id1")), (2, "p1", None, T0, data("/r/a/sub", None)), (3, "p1", None, T0, data("/new", "id9"))],
        schema.OBSERVATIONS,
    )
    after, matched = associate.upsert_worktrees(trees, obs)
    paths = {r.worktree_id: r.path for r in after.collect()}
    assert paths["w1"] == "/moved" and paths["w2"] == "/r/a/sub" and len(paths) == 3
    assert {r.observation_id: r.worktree_id for r in matched.collect()}[1] == "w1"


def test_recorded_moves_and_intervals(spark):
    def run(i, sid, pos, command, cwd="/r/old", text="", status=0):
        meta = dict.fromkeys(schema.METADATA_FIELDS)
        meta.update(command=command, execution_source="native_command_execution", exit_status=status)
        return (f"x{i}", sid, sid, f"n{i}", "codex", "tool", "recorded_tool_result", text, T0 + dt.timedelta(minutes=i), None, "known", cwd,
                tuple(meta.values()), None, None, "missing_working_directory", "g", pos)

    root = "git rev-parse --show-toplevel"
    rows = [
        run(1, "ok", 1, "ls"), run(2, "ok", 3, "mv /r/old /r/new"), run(3, "ok", 4, root, "/r/new", "/r/new\n"),
        run(4, "late", 1, "ls", "/q/old"), run(5, "late", 2, "mv /q/old /q/new", "/q"), run(6, "late", 3, "ls", "/q"), run(7, "late", 4, root, "/q/new", "/q/new"),
        run(8, "bare", 2, "mv /z/old /z/new", "/z"), run(9, "bare", 3, root, "/z/new", "/z/new"),
        run(10, "pipe", 1, "mv /y/a /y/b && ls", "/y/a"),
    ]
    live = spark.createDataFrame(rows, schema.RECORDS + ", generation_id string, position long")
    trees = spark.createDataFrame([("w1", "p1", "id1", "/r/new", True), ("w2", "p1", "id2", "/q/new", True)], schema.WORKTREES)
    projects = spark.createDataFrame([("p1", "P", "c", "/c", T0)], schema.PROJECTS)
    data = lambda path, ident="id1": (path, None, None, "c", ident, "main", "h", [], [], [], True, [])
    obs = [(1, "p1", "w1", T0, data("/r/old")), (2, "p1", "w1", T0 + dt.timedelta(minutes=2, seconds=30), data("/r/new")), (3, "p1", "w1", T0 + dt.timedelta(hours=9), data("/r/new"))]
    observations = spark.createDataFrame(obs, schema.OBSERVATIONS)
    verdicts = moves.reconcile_moves(live, trees, observations, projects).cache()
    assert {r.record_id: r.failure for r in verdicts.collect()} == {
        "x2": None, "x5": "intervening_execution_requires_review", "x8": "missing_prior_source_context"}
    linked = moves.move_associations(live, verdicts)
    assert {r.record_id for r in linked.collect()} == {"x1", "x2"}
    applied = {r.record_id: r.worktree_id for r in moves.apply_associations(live, linked).collect()}
    assert applied["x1"] == "w1" and applied["x4"] is None
    gone = moves.revoke_unsupported(moves.apply_associations(live, linked), linked.filter("record_id = 'x2'"))
    assert {r.record_id: r.association_reason for r in gone.collect()}["x1"] == "move_evidence_unresolved"
    spans = moves.identity_intervals(observations, trees, projects)
    span = spans.collect()
    assert [(r.from_path, r.to_path, r.until) for r in span] == [("/r/old", "/r/new", T0 + dt.timedelta(minutes=2, seconds=30))]
    assert {r.record_id for r in moves.associate_by_interval(live, spans).collect()} == {"x1", "x2"}


def test_evidence_is_worked_out_once(spark, monkeypatch):
    """Judging the same records twice reads written executions and evidence; no plan holds a command's words."""
    from pyspark.sql import functions as F
    from worklore import schema

    meta = schema.metadata(command=F.col("command"), execution_source=F.lit("native_command_execution"), exit_status=F.lit(0).cast("long"))
    rows = [(f"x{n}-{p}", f"s{n}", p, c.format(n=n), d.format(n=n), o.format(n=n)) for n in (1, 2) for p, c, d, o in (
        (1, "ls", "/r/{n}/old", ""), (2, "mv /r/{n}/old /r/{n}/new", "/r/{n}/old", ""), (3, "git rev-parse --show-toplevel", "/r/{n}/new", "/r/{n}/new\n"))]
    live = spark.createDataFrame(rows, "record_id string, session_id string, position long, command string, cwd string, text string").select(
        "record_id", "session_id", F.lit("g").alias("generation_id"), F.lit("n").alias("native_id"), F.lit("tool").alias("actor"),
        F.lit("recorded_tool_result").alias("kind"), "text", F.lit(None).cast("timestamp").alias("event_time"), "cwd", meta.alias("metadata"), "position",
    )
    trees = spark.createDataFrame([(f"w{n}", "p", f"id{n}", f"/r/{n}/new", True) for n in (1, 2)],
                                  "worktree_id string, project_id string, identity string, path string, active boolean")
    projects = spark.createDataFrame([("p", "c")], "project_id string, common_identity string")
    seen = spark.createDataFrame([(("/r/2/old", "other", "c", True),)],
                                 "data struct<path:string,worktree_identity:string,common_identity:string,available:boolean>")
    calls, real = [], moves.executions
    monkeypatch.setattr(moves, "executions", lambda rows: calls.append(1) or real(rows))
    found = moves.move_evidence(live)
    verdicts = [moves.reconcile_moves(live, trees, x, projects, found) for x in (seen.limit(0), seen)]
    assert [{r.record_id: r.failure for r in v.collect()} for v in verdicts] == [
        {"x1-2": None, "x2-2": None}, {"x1-2": None, "x2-2": "historical_git_identity_conflict"}]
    assert len(calls) == 1
    assert "command" not in moves.reconcile_moves(live, trees, seen, projects)._jdf.queryExecution().optimizedPlan().toString()


def test_sections_chunk_exactly(spark):
    long = "\n".join("word " * 150 for _ in range(8))
    text = f"# T\n\n{long}\n\n" + "y" * 7200 + "\n"
    out = docs.sectionize(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("number").collect()
    assert max(len(r.text) for r in out) <= 3500 and out[0].section == "T"
    assert "".join(r.text.replace("\n", "") for r in out) == text.replace("# T", "").replace("\n", "")
    assert [r.segment_order for r in out] == list(range(1, len(out) + 1)) and {r.segment_count for r in out} == {len(out)}


def test_brief_facets(spark):
    names = VIEW + ", relative_path string, section string"
    rows = []
    for i in range(9):
        rows.append((*item(i, "task", f"Unfinished step {i % 6}", status="pending", at=None, actor="document", category="documented_pending"), "S.md", "Pending"))
    rows.append((*item(20, "claim", "Schema 3 removes the old table", at=None, actor="document", category="documented_claim", status="unverified"), "S.md", "R"))
    for i in range(30, 40):
        rows.append((*item(i, "claim", f"We ran {i} checks", at=None, actor="document", category="documented_claim", status="unverified"), "S.md", "R"))
    rows.append((*item(50, "purpose", "A probe", at=None, actor="document", category="documented_purpose", status="documented"), "README.md", ""))
    shown = facets.brief_facets(spark.createDataFrame(rows, names)).groupBy("facet").count().collect()
    assert {r.facet: r["count"] for r in shown} == {"pending": 5, "claims": 7, "purpose": 1}


def test_search_index_agrees_with_scan(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gämma", "delta", "e2e-test", "zeta"]
    rows = [(f"r{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, text string")
    search.build_index(df, f"{tmp_path}/ix", term_buckets=4, document_buckets=2)
    for q in ("alpha gamma", "e2e-test", "beta delta alpha"):
        a = [(r.record_id, round(r.score, 9)) for r in search.search(df, q, 15).collect()]
        b = [(r.id, round(r.score, 9)) for r in search.search_index(spark, f"{tmp_path}/ix", q, 15, term_buckets=4).collect()]
        assert a == b and a
    assert search.search_index(spark, f"{tmp_path}/ix", "--", term_buckets=4).count() == 0


def test_index_shuffles_postings_not_places(spark, tmp_path):
    """Rows of one id share their postings; null, empty and wordless texts have none, but a length."""
    rows = [("a", "x y x"), ("a", "y x"), (None, "x"), (None, "x z"), ("b", ""), ("c", None), ("d", "--"), ("e", "y" + " x" * 300)]
    df = spark.createDataFrame(rows, "record_id string, text string").repartition(3)
    search.build_index(df, f"{tmp_path}/odd", term_buckets=3, document_buckets=2)
    found = {(r.term, r.id): r.positions for r in spark.read.parquet(f"{tmp_path}/odd/postings").collect()}
    want = {("x", "a"): [0, 1, 2], ("y", "a"): [0, 1], ("x", None): [0, 0], ("z", None): [1], ("y", "e"): [0], ("x", "e"): [*range(1, 301)]}
    assert found == want
    lengths = [(r.id, r.length) for r in spark.read.parquet(f"{tmp_path}/odd/lengths").collect()]
    assert sorted(map(str, lengths)) == sorted(map(str, [("a", 3), ("a", 2), (None, 1), (None, 2), ("b", 0), ("c", None), ("d", 0), ("e", 301)]))
    plan = search.postings(df, "record_id", "text", 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Sort [") == 1 and "ENSURE_REQUIREMENTS" not in plan


def test_index_of_a_long_text_is_linear(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(200_000))
    search.build_index(spark.createDataFrame([("r", text)], "record_id string, text string"), f"{tmp_path}/long", term_buckets=2)
    assert spark.read.parquet(f"{tmp_path}/long/postings").count() == 200_000


def test_resume_and_export(spark):
    items = [item(1, "objective", "ship it", at=1), item(2, "task", "build", at=2), item(3, "blocker", "stuck", at=3, status="blocked"),
             item(4, "decision", "keep", at=4), item(5, "task", "doc work", at=None, actor="document", status="pending", category="documented_pending")]
    scoped = spark.createDataFrame(items, VIEW).drop("source_current").withColumn(
        "provider", F.when(F.col("actor") == "document", "project_document").otherwise(F.col("provider")))
    rec = scoped.select("record_id", "session_id", F.lit("s").alias("session_native_id"), "native_id", "provider", "actor",
                        F.lit("user_intent").alias("kind"), "text", "event_time", "time_status", "project_id", "worktree_id",
                        *[F.lit(None).cast("string").alias(c) for c in ("event_type", "revision", "relative_path", "section")],
                        F.lit(None).cast("bigint").alias("exit_status"))
    tables = {
        "items": scoped, "records": rec,
        "projects": spark.createDataFrame([("p", "Probe", "c", "/c", T0)], schema.PROJECTS),
        "worktrees": spark.createDataFrame([("w", "p", "id", "/w", True)], schema.WORKTREES),
        "observations": spark.createDataFrame([], schema.OBSERVATIONS),
        "occurrences": rec.select("record_id", F.lit("g").alias("generation_id"), F.lit("line:1").alias("locator"), F.lit(1).alias("position")),
        "generations": spark.createDataFrame([("g", "src", 1, "current", T0)], schema.GENERATIONS),
        "sources": spark.createDataFrame([("src", "codex", "/x", None, 1, T0, "partial", 1, 1, None, T0)], schema.SOURCES),
        "corrections": spark.createDataFrame([], schema.CORRECTIONS),
        "associations": spark.createDataFrame([], schema.ASSOCIATIONS),
        "memory": spark.createDataFrame([], schema.MEMORY),
    }
    parts = resume.resume(tables, "p")
    assert parts["objective"].first()["text"] == "ship it"
    actions = parts["next_actions"].orderBy("rank").collect()
    assert [(a.text, a.availability) for a in actions] == [("doc work", "source_partial_last_known_pending"), ("build", "current")]
    assert parts["latest_instruction"].first()["text"] == "keep"
    assert {(r.code, r.detail) for r in parts["uncertainties"].collect()} == {("incomplete_source", "src")}
    parts = {name: df.cache() for name, df in parts.items()}
    hard = dict(parts)
    hard["items"] = parts["items"].withColumn("text", F.concat("text", F.repeat(F.lit("<&*_\"\\"), 80)))
    for form, budget in (("markdown", 2000), ("json", 2600)):
        sizes = [len(r["document"]) for r in resume.export(hard, tables["projects"], budget, form).collect()]
        assert sizes and max(sizes) <= budget
    doc = resume.export(parts, tables["projects"], 4000).first()["document"]
    assert doc.startswith("# Resume: Probe") and len(doc) <= 4000 and "doc work" in doc
    assert json.loads(resume.export(parts, tables["projects"], 4000, "json").first()["document"])["entries"]


def test_streams(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")

    def drop(name, ids):
        rows = [{"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}] + [
            {"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "id": i, "role": "user", "content": f"TASK: {i}"}} for i in ids] + [{"type": "mystery", "payload": {}}] * (name == "b")
        open(f"{tmp_path}/in/{name}.jsonl", "w").write("".join(json.dumps(r) + "\n" for r in rows))

    trees = spark.createDataFrame([("w1", "p1", "id1", "/w", True)], schema.WORKTREES)

    def go():
        landing.arrive(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp1", "codex", trees).awaitTermination(120)
        q = landing.publish(spark, f"{tmp_path}/out", f"{tmp_path}/cp2")
        q.awaitTermination(120)
        return q.lastProgress

    drop("a", ["1", "2"])
    go()
    drop("b", ["2", "3"])
    progress = go()
    assert progress["sources"][0]["numInputRows"] <= 3  # the second batch reads what arrived for it, not history
    table = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    rows = table("records").collect()
    assert sorted(r.native_id for r in rows) == ["1", "2", "3", "line:1"] and {(r.session_native_id, r.project_id) for r in rows} == {("s", "p1")}
    # the streams give what one pass over all files gives
    events = normalize.normalize("codex", transcripts.parse_lines(transcripts.read_transcripts(spark, f"{tmp_path}/in")))
    whole = normalize.records_of(events)
    assert {r.record_id for r in rows} == {r.record_id for r in whole.collect()}
    places = lambda df: sorted((r.record_id, r.locator) for r in df.select("record_id", "locator", "source_path").collect())
    assert places(table("occurrences")) == places(whole)
    assert sorted(r.text for r in table("items").collect()) == ["1", "2", "3"] and {r.project_id for r in table("items").collect()} == {"p1"}
    assert table("gaps").count() == events.filter("code is not null").count() == 1

    calls = [(i, T0 + dt.timedelta(minutes=30 * i), "run", "ok" if i % 3 else "failed", 10) for i in range(8)] + [(99, T0 + dt.timedelta(days=9), "run", "ok", 10)]
    spark.createDataFrame(calls, "activity_id long, at timestamp, tool string, status string, duration_ms long").coalesce(1).write.parquet(f"{tmp_path}/act")
    stream = spark.readStream.schema("activity_id long, at timestamp, tool string, status string, duration_ms long").parquet(f"{tmp_path}/act")
    q = activity.rolling_stats(stream, span="1 hour", slide="1 hour").writeStream.format("memory").queryName("stats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.window_start, r.calls, r.failures) for r in spark.table("stats").collect())
    assert got == [(T0 + dt.timedelta(hours=h), 2, 0 if h == 2 else 1) for h in range(4)]
