"""Registered queries over what a refresh keeps: offsets, whole texts, moves, document states."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

import entry_tables as E
from entry_queries import query
from worklore import schema, session
from worklore.functions import patterns as P
from worklore.operators import docs, extract, moves, normalize
from worklore.plans import refresh
from worklore.sources import docfiles, manifest, ranges, transcripts

_EARLY = "event_id % 2000 < 1000"


def _folder(spark, name: str) -> str:
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rollouts(events: DataFrame) -> DataFrame:
    """(part, block, event_id, value): a file's header and one line per event; a view changes the directory."""
    keys = [(F.col("user_id") % 5).alias("part"), F.floor(F.col("event_id") / 2000).alias("block")]
    number = F.col("event_id").cast("string")
    text = F.struct(F.lit("input_text").alias("type"), F.concat(F.lit("Probe "), number).alias("text"))
    said = F.struct(
        F.lit("message").alias("type"), F.concat(F.lit("m"), number).alias("id"), F.lit("user").alias("role"), F.array(text).alias("content")
    )
    moved = F.struct(F.concat(F.lit("/w/"), number).alias("cwd"))
    line = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    lines = events.select(
        *keys, "event_id", F.when(F.col("event_type") == "view", line("turn_context", moved)).otherwise(line("response_item", said)).alias("value")
    )
    head = F.struct(F.concat_ws("-", F.lit("s"), "part", "block").alias("id"), F.lit("/w/home").alias("cwd"))
    heads = lines.select("part", "block").distinct().select("part", "block", F.lit(-1).alias("event_id"), line("session_meta", head).alias("value"))
    return lines.unionByName(heads)


def _written(spark, rows: DataFrame, folder: str) -> DataFrame:
    """One file per part and block, and its listing."""
    ordered = rows.repartition("part", "block").sortWithinPartitions("part", "block", "event_id").drop("event_id")
    ordered.write.partitionBy("part", "block").text(folder)
    return manifest.build_manifest(spark, [folder], P.PROVIDER_ROLLOUT, "part-*").select(F.col("path").alias("source_path"), "length")


def _number(name: str) -> Column:
    return F.regexp_extract("source_path", f"/{name}=([0-9]+)/", 1).cast("bigint").alias(name)


def _measured(files: DataFrame) -> DataFrame:
    return session.stage(ranges.measured(ranges.chunked(files, 4096)), "measured")


@query("""WITH e AS (SELECT user_id % 5 AS part, event_id // 2000 AS block, event_id, event_type,
  1 + row_number() OVER (PARTITION BY user_id % 5, event_id // 2000 ORDER BY event_id) AS line_no,
  last_value(CASE WHEN event_type = 'view' THEN '/w/' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 5, event_id // 2000 ORDER BY event_id) AS near
  FROM events)
 SELECT part, block, 's-' || part || '-' || block AS session, 'm' || event_id AS native_id, line_no, coalesce(near, '/w/home') AS cwd
 FROM e WHERE event_type <> 'view' AND event_id % 2000 >= 1000""")
def appended_tails(spark, sf_dir):
    """Files are read once up to an offset, then grow; only what was appended is read, with the context carried to there."""
    events = E.table(spark, sf_dir, "events")
    rows = _rollouts(events)
    files = _written(spark, rows.filter(f"event_id < 0 or {_EARLY}"), _folder(spark, "early"))
    chunks = _measured(files.withColumn("seen", F.lit(0).cast("long")))
    ends = ranges.marks(chunks)
    start = files.select("source_path", F.lit(0).cast("long").alias("from_offset"), F.lit(0).cast("long").alias("from_line"))
    lines = session.stage(ranges.read_lines(chunks, start), "early-lines")
    known = normalize.contexts(P.PROVIDER_ROLLOUT, transcripts.parse_lines(lines)).join(ends, "source_path").select(
        _number("part"), _number("block"), F.col("byte_offset").alias("seen"), F.col("lines").alias("from_line"), F.col("prefix_hash").alias("known_hash"), "context"
    )
    known = session.stage(known, "marks")
    grown = _written(spark, rows, _folder(spark, "grown")).select("source_path", "length", _number("part"), _number("block"))
    grown = grown.join(known, ["part", "block"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    chunks = _measured(grown)
    intact = ranges.marks(chunks).select("source_path", "seen_hash")
    due = grown.join(intact, "source_path").filter("known_hash = seen_hash")  # the known prefix is as it was
    due = session.stage(due.select("source_path", F.col("seen").alias("from_offset"), "from_line", "context"), "due")
    tail = session.stage(ranges.read_lines(chunks, due.drop("context")), "tail")
    found = normalize.normalize_rollout(transcripts.parse_lines(tail), due.select("source_path", "context"))
    r = F.col("record")
    return found.filter(r["kind"] == "user_intent").select(
        _number("part"), _number("block"), r["session_native_id"].alias("session"), r["native_id"].alias("native_id"), "line_no", r["cwd"].alias("cwd")
    )


def _stored(spark, records: DataFrame) -> refresh.Store:
    """Records committed to a store of their own, whole texts beside them."""
    store = refresh.Store(spark, _folder(spark, "store"))
    names = refresh._names(refresh.TABLES["records"])
    rows = records.withColumn("text_digest", refresh.text_digest())
    null = F.lit(None).cast("string")
    rows = rows.withColumns({n: null for n in ("project_id", "worktree_id", "association_reason")})
    rows = session.stage(rows.select(*names, "full_text"), "new-records")
    store.write_texts(rows, 1)
    store.write("records", rows.select(*names), 1)
    now = F.current_timestamp()
    stats = F.create_map(F.lit("parsed"), F.lit(0).cast("long"))
    store.commit(
        spark.range(1).select(
            F.lit(1).cast("long").alias("run_id"), now.alias("started_at"), now.alias("ended_at"), F.lit("passed").alias("status"),
            F.lit(refresh.PIPELINE).alias("pipeline"), stats.alias("stats"),
        )
    )
    return store


def _as_records(texts: DataFrame, key: Column, text: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return normalize.with_identity(
        texts.select(
            F.lit("codex").alias("provider"), F.lit("s").alias("session_native_id"), key.alias("native_id"), F.lit("user").alias("actor"),
            F.lit("user_intent").alias("kind"), text.alias("full_text"), null.alias("original_time"), null.alias("cwd"), schema.metadata().alias("metadata"),
        )
    )


@query("""SELECT doc_id, length(text) AS characters, sha256(text) AS digest, length(text) > 4096 AS cut,
  CASE WHEN length(text) > 4096 THEN regexp_extract(text, '(\\S+)\\s*$', 1) END AS last_word FROM documents WHERE text IS NOT NULL""")
def stored_texts(spark, sf_dir):
    """Every document as a record of a store, read back whole: also what lies beyond the excerpt."""
    d = E.table(spark, sf_dir, "documents").filter("text is not null")
    store = _stored(spark, _as_records(d, F.col("doc_id").cast("string"), F.col("text")))
    whole, cut = F.col("full_text"), F.col("text_digest").isNotNull()
    return store.full_records().select(
        F.col("native_id").cast("bigint").alias("doc_id"), F.length(whole).cast("bigint").alias("characters"), F.sha2(whole, 256).alias("digest"),
        cut.alias("cut"), F.when(cut, F.regexp_extract(whole, r"(\S+)\s*$", 1)).alias("last_word"),
    )


@query("""SELECT event_type, count(*) AS items, sum(length(item))::BIGINT AS letters, sum(event_id)::BIGINT AS ids
 FROM (SELECT event_type, event_id, concat('Repair probe ', CAST(event_id AS VARCHAR), '.') AS item FROM events) e GROUP BY 1""")
def reextracted_items(spark, sf_dir):
    """Statements derived anew from a store alone; most lie beyond the excerpts of their records."""
    texts = E.statement_texts(E.table(spark, sf_dir, "events"))
    key = F.to_json(F.struct("event_type", "block"))
    store = _stored(spark, _as_records(texts, key, F.col("text")))
    records = store.full_records().select("record_id", "provider", "actor", "kind", "full_text", F.lit(None).cast("string").alias("tool"))
    items = extract.extract_items(records).join(store.table("records").select("record_id", "native_id"), "record_id")
    event_type = F.get_json_object("native_id", "$.event_type").alias("event_type")
    return items.groupBy(event_type).agg(
        F.count("*").alias("items"), F.sum(F.length("text")).cast("bigint").alias("letters"),
        F.sum(F.regexp_extract("text", "([0-9]+)", 1).cast("bigint")).alias("ids"),
    )


_BLOB = "sha1('blob ' || strlen(text) || chr(0) || text)"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'false' WHEN 3 THEN 'unknown' ELSE 'true' END AS modified,
  CASE doc_id % 4 WHEN 0 THEN {_BLOB} WHEN 1 THEN sha1('blob 3' || chr(0) || 'old') ELSE 'unknown' END AS committed_blob,
  CASE doc_id % 4 WHEN 2 THEN 'false' WHEN 3 THEN 'unknown' ELSE 'true' END AS tracked,
  CASE WHEN doc_id % 4 < 3 THEN 'h' || doc_id % 7 END AS git_head, true AS carried FROM documents WHERE text IS NOT NULL""")
def working_tree_documents(spark, sf_dir):
    """Documents against an observed tree: equal, changed, untracked and unobserved ones, and the facts on their sections."""
    d = E.spread(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    raw = F.col("text").cast("binary")
    place = [F.lit("/r").alias("root_path"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path")]
    documents = d.select(
        "doc_id", *place, raw.alias("content"), "text", F.col("doc_id").cast("string").alias("document_id"), F.sha2(raw, 256).alias("fingerprint")
    )
    blob = lambda content, size: F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), size), "UTF-8"), F.lit(b"\x00"), content))
    kind = F.col("doc_id") % 4
    committed = F.when(kind == 0, blob(raw, F.octet_length(raw).cast("string"))).when(kind == 1, blob(F.encode(F.lit("old"), "UTF-8"), F.lit("3")))
    tree = d.filter(kind < 3).select(
        *place, committed.alias("committed_blob"), (kind < 2).alias("tracked"), F.concat(F.lit("h"), (F.col("doc_id") % 7).cast("string")).alias("git_head")
    )
    facts = ["modified", "committed_blob", "tracked", "git_head"]
    state = docs.working_tree_state(documents, tree).select("doc_id", "document_id", "relative_path", "root_path", "fingerprint", "text", *facts)
    state = session.stage(state, "states")
    sections = docs.section_records(state, F.lit("2026-01-01").cast("timestamp"))
    m = F.col("metadata")
    carried = sections.select(F.col("session_native_id").alias("document_id"), F.struct(*[m[f].alias(f) for f in facts]).alias("seen"))
    joined = state.join(carried, "document_id", "left").withColumn(
        "same", F.coalesce(F.to_json("seen") == F.to_json(F.struct(*facts)), F.lit(True))
    )
    return joined.groupBy("doc_id", *facts).agg(F.min("same").alias("carried"))


# Commands of a session by kind: (position, command, directory, output); {n} is the event's number.
_LS, _MOVE, _ROOT = "ls", "mv /r/{n}/old /r/{n}/new", "git rev-parse --show-toplevel"
_CHECK = (_ROOT, "/r/{n}/new", "/r/{n}/new\n")
_PLAIN = [(1, _LS, "/r/{n}/old", ""), (2, _MOVE, "/r/{n}/old", ""), (3, *_CHECK)]
_SCRIPTS = [
    _PLAIN,
    [(1, _LS, "/else", ""), (2, _MOVE, "/else", ""), (3, *_CHECK)],
    [*_PLAIN, (4, "mv /r/{n}/new /r/{n}/newer", "/r/{n}/new", ""), (5, _ROOT, "/r/{n}/newer", "/r/{n}/newer")],
    _PLAIN[:2],
    [*_PLAIN[:2], (3, _LS, "/r/{n}", ""), (4, *_CHECK)],
    [_PLAIN[0], (2, *_CHECK), (3, _MOVE, "/r/{n}/old", ""), (4, *_CHECK)],
    [_PLAIN[0], (2, "cp /r/{n}/old /r/{n}/copy", "/r/{n}", ""), (3, _MOVE, "/r/{n}/old", ""), (4, *_CHECK)],
    _PLAIN,
    _PLAIN,
    _PLAIN,
]
_FAILURES = [
    None, "missing_prior_source_context", "ambiguous_move_endpoints", "missing_later_git_root_evidence",
    "intervening_execution_requires_review", "destination_existed_before_move", "copy_operation_conflicts_with_move",
    "destination_not_uniquely_registered", "separate_or_nested_worktree", "historical_git_identity_conflict",
]


def _move_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Executions of one session per event (its script by event_id % 10), worktrees, observations, projects."""
    events = E.spread(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind, number = F.col("event_id") % 10, F.col("event_id").cast("string")
    step = lambda s: F.struct(
        F.lit(s[0]).cast("long").alias("position"), *[F.lit(x).alias(n) for x, n in zip(s[1:], ("command", "cwd", "output"), strict=True)]
    )
    scripts = F.array(*[F.array(*[step(s) for s in script]) for script in _SCRIPTS])
    runs = events.select("event_id", "ts", number.alias("n"), F.explode(F.get(scripts, kind.cast("int"))).alias("s"))
    fill = lambda c: F.replace(F.col(c), F.lit("{n}"), F.col("n"))
    meta = schema.metadata(command=fill("s.command"), execution_source=F.lit("native_command_execution"), exit_status=F.lit(0).cast("long"))
    session_id = F.concat(F.lit("s"), F.col("n"))
    live = runs.select(
        F.concat(F.lit("x"), "n", F.lit("-"), F.col("s.position").cast("string")).alias("record_id"), session_id.alias("session_id"),
        F.concat(F.lit("n"), "n").alias("native_id"), F.lit("tool").alias("actor"), F.lit("recorded_tool_result").alias("kind"),
        fill("s.output").alias("text"), F.col("ts").alias("event_time"), F.lit("known").alias("time_status"), fill("s.cwd").alias("cwd"),
        meta.alias("metadata"), F.lit("g").alias("generation_id"), F.col("s.position").alias("position"),
        F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("string").alias("worktree_id"),
        F.lit("missing_working_context").alias("association_reason"),
    )
    place = lambda end: F.concat(F.lit("/r/"), number, F.lit(end))
    tree = lambda name, end: events.select(
        F.concat(F.lit(name), number).alias("worktree_id"), F.lit("p").alias("project_id"), F.concat(F.lit("id"), number).alias("identity"),
        place(end).alias("path"), F.lit(True).alias("active"), kind.alias("kind"),
    )
    worktrees = tree("w", "/new").filter("kind <> 7").unionByName(tree("o", "/old").filter("kind = 8")).drop("kind")
    observed = events.filter(kind == 9).select(
        F.col("event_id").alias("observation_id"), F.col("ts").alias("observed_at"),
        F.struct(place("/old").alias("path"), F.lit("other").alias("worktree_identity"), F.lit("c").alias("common_identity"), F.lit(True).alias("available")).alias("data"),
    )
    projects = spark.range(1).select(F.lit("p").alias("project_id"), F.lit("c").alias("common_identity"))
    return session.stage(live, "executions"), worktrees, observed, projects


_VERDICTS = " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_FAILURES) if f)


@query(f"""SELECT 'x' || event_id || '-' || place AS record_id, CASE event_id % 10 {_VERDICTS} END AS failure,
  CASE WHEN event_id % 10 = 0 THEN 'w' || event_id END AS worktree_id,
  CASE WHEN event_id % 10 = 0 THEN 'x' || event_id || '-1' END AS anchor_record_id
 FROM (SELECT event_id, CASE WHEN event_id % 10 IN (5, 6) THEN 3 ELSE 2 END AS place FROM events
       UNION ALL SELECT event_id, 4 AS place FROM events WHERE event_id % 10 = 2) m""")
def recorded_moves(spark, sf_dir):
    """The verdict on every recorded move; each reason to reject one occurs."""
    verdicts = moves.reconcile_moves(*_move_tables(spark, sf_dir))
    return verdicts.select("record_id", "failure", "worktree_id", "anchor_record_id")


@query("""SELECT CASE event_id % 10 WHEN 0 THEN 'recorded_move_evidence' ELSE 'move_evidence_unresolved' END AS association_reason,
  CASE event_id % 10 WHEN 0 THEN 'w' || event_id END AS worktree_id, 'x' || event_id || '-' || place AS record_id
 FROM events, (VALUES (1), (2)) t(place) WHERE event_id % 10 IN (0, 9)
 UNION ALL SELECT 'missing_working_context', NULL, 'x' || event_id || '-' || place FROM events, (VALUES (1), (2), (3), (4), (5)) t(place)
 WHERE place <= CASE WHEN event_id % 10 = 3 THEN 2 WHEN event_id % 10 = 2 THEN 5 WHEN event_id % 10 IN (4, 5, 6) THEN 4 ELSE 3 END
   AND NOT (event_id % 10 IN (0, 9) AND place < 3)""")
def revoked_moves(spark, sf_dir):
    """Attributions by moves, of which later observations withdraw some."""
    live, worktrees, observed, projects = _move_tables(spark, sf_dir)
    found = moves.move_evidence(live)
    linked = lambda seen: session.stage(moves.move_associations(live, moves.reconcile_moves(live, worktrees, seen, projects, found)), "linked")
    given = moves.apply_associations(live, linked(observed.limit(0)))
    return moves.revoke_unsupported(given, linked(observed)).select("record_id", "worktree_id", "association_reason")


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a table; those that rows lack are null."""
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields(refresh.TABLES[table])]
    )


_GONE = f"""SELECT DISTINCT t.session_id FROM ({E.for_check(E.TRANSCRIPTS)}) t JOIN ({E.for_check(E.OCCURRENCES)}) o USING (record_id)
 JOIN ({E.for_check(E.GENERATIONS)}) g USING (generation_id) JOIN ({E.for_check(E.SOURCES)}) s ON s.source_id = g.source_id
 WHERE s.path LIKE '/sessions/src3.jsonl'"""


@query(f"""WITH gone AS ({_GONE}), kept AS (SELECT * FROM ({E.for_check(E.TRANSCRIPTS)}) t WHERE session_id NOT IN (SELECT session_id FROM gone))
 SELECT 'records' AS entity, count(*) AS rows, sum(substring(record_id, 2)::BIGINT)::BIGINT AS ids FROM kept
 UNION ALL SELECT 'items', count(*), sum(substring(record_id, 2)::BIGINT)::BIGINT FROM kept
 UNION ALL SELECT 'occurrences', count(*), sum(substring(record_id, 2)::BIGINT)::BIGINT FROM ({E.for_check(E.OCCURRENCES)}) o JOIN kept USING (record_id)
 UNION ALL SELECT 'texts', count(DISTINCT text), 0 FROM kept
 UNION ALL SELECT 'excluded', count(*), 0 FROM ({E.for_check(E.SOURCES)}) s WHERE path LIKE '/sessions/src3.jsonl'
 UNION ALL SELECT 'marks', count(*), 0 FROM ({E.for_check(E.SOURCES)}) s WHERE path NOT LIKE '/sessions/src3.jsonl'""")
def forgotten_store(spark, sf_dir):
    """A store of two runs after a source was excluded: what hangs on it is gone from every table, the rest is as it was."""
    store = refresh.Store(spark, _folder(spark, "store"))
    texts = E.records(spark, sf_dir).withColumn("full_text", F.repeat("text", 200)).withColumn("text", F.substring("full_text", 1, 4096))
    records = session.stage(texts.withColumn("text_digest", refresh.text_digest()), "records")
    occurrences, sources = E.derived(spark, sf_dir, E.OCCURRENCES), E.derived(spark, sf_dir, E.SOURCES)
    number = F.substring("record_id", 2, 20).cast("long")
    for run in (1, 2):
        mine = number % 2 == run - 1
        store.write_texts(records.filter(mine), run)
        for name, rows in (("records", records), ("occurrences", occurrences), ("items", E.items(spark, sf_dir))):
            store.write(name, _shaped(rows.filter(mine), name), run)
        for name, rows in (("sources", sources), ("marks", sources), ("diagnostics", sources.limit(0))):
            store.write(name, _shaped(rows, name), run)
        refresh._commit(store, run, spark.sql("select current_timestamp() as t").first()["t"], "passed", {"parsed": 0})
    store.write("generations", _shaped(E.derived(spark, sf_dir, E.GENERATIONS), "generations"), 2)
    refresh.exclude_sources(store, "/sessions/src3.jsonl")
    refresh.purge(store)
    ids = lambda name: store.table(name).agg(F.lit(name).alias("entity"), F.count("*").alias("rows"), F.sum(number).alias("ids"))
    count = lambda name, rows: rows.agg(F.lit(name).alias("entity"), F.count("*").alias("rows"), F.lit(0).cast("long").alias("ids"))
    out = ids("records").unionAll(ids("items")).unionAll(ids("occurrences")).unionAll(count("texts", store.table("texts")))
    excluded = store.table("sources").filter("status = 'excluded'")
    return out.unionAll(count("excluded", excluded)).unionAll(count("marks", store.table("marks")))


def _write_blocks(texts: DataFrame, place: str) -> None:
    """One file of lines per block, as rows come; a block's rows follow each other within a task.

    Spark's own writer takes several system calls and a rename per file, some in processes of their own.
    """

    def run(arriving):
        out, current, files = None, (), 0
        for batch in arriving:
            for block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != current:
                    if out:
                        out.close()
                    out, current, files = ranges.create_file(f"{place}/block={block}/part-0.txt"), block, files + 1
                out.write(text + b"\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    block = F.coalesce(F.col("block").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("block")
    texts.select(block, F.col("text").cast("binary")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


@query("""WITH d AS (SELECT doc_id // 50 AS block, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1)
 SELECT block, 'docs' AS folder, CAST(NULL AS VARCHAR) AS code, sha256(content) AS fingerprint, length(content) AS characters FROM d
 UNION ALL SELECT block, 'raw', 'document_binary_unsupported', sha256(chr(0) || content), NULL FROM d""")
def scanned_documents(spark, sf_dir):
    """A tree of document files, binary ones and a private folder among them; what is private is never opened."""
    folder = _folder(spark, "tree")
    rows = E.table(spark, sf_dir, "documents").filter("text is not null").select(F.floor(F.col("doc_id") / 50).alias("block"), "doc_id", "text")
    dealt = rows.repartition("block").sortWithinPartitions("block", "doc_id")
    first = F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("block"))
    raw = rows.withColumn("text", F.when(first, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text")))
    for place, texts in (("docs", dealt), ("docs/raw", raw.repartition("block").sortWithinPartitions("block", "doc_id")), ("logs", dealt)):
        _write_blocks(texts, f"{folder}/{place}")
    root = folder.removeprefix("file:").replace("///", "/")
    found = docfiles.read_documents(spark, root, "p", "w", patterns=["**/part-*.txt"])
    relative = F.col("relative_path")
    return found.select(
        F.regexp_extract(relative, "block=([0-9]+)/", 1).cast("bigint").alias("block"),
        F.when(relative.startswith("docs/raw/"), "raw").otherwise(F.regexp_extract(relative, "^([^/]+)/", 1)).alias("folder"),
        "code", "fingerprint", F.length("text").cast("bigint").alias("characters"),
    )
