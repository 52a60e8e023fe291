"""Refresh: bring the tables up to date with changed sources, once per change.

Every run writes its rows under `run_id=N` and becomes visible with its row in
`refresh_runs`, written last.  A run that dies leaves nothing visible, and its
number is written over by the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema, session
from ..functions import hashing, pathops, patterns as P
from ..operators import associate as assoc, docs, evidence, extract, identity, normalize, resolve
from ..sources import chatstore, manifest, ranges, sinks, transcripts

PIPELINE = "worklore-1"
UNREADABLE = "source_unreadable"
RUNS = "run_id long, started_at timestamp, ended_at timestamp, status string, pipeline string, stats map<string,bigint>"
ITEMS = schema.ITEMS + (
    ", session_id string, native_id string, project_id string, worktree_id string, provider string, "
    "actor string, event_time timestamp, time_status string"
)
TABLES = {
    "records": schema.RECORDS + ", text_digest string",
    "texts": "digest string, full_text string, bucket string",
    "retired": "name string, retired_run long",
    "marks": "source_id string, byte_offset long, context " + normalize.CONTEXT,
    "occurrences": schema.OCCURRENCES,
    "generations": "generation_id string, source_id string, number int",
    "sources": schema.SOURCES,
    "diagnostics": schema.SOURCE_DIAGNOSTICS,
    "items": ITEMS,
    "memory": schema.MEMORY,
    "corrections": schema.CORRECTIONS,
}


OCCURRING = (
    "record_id string, session_id string, session_native_id string, native_id string, provider string, actor string, "
    "kind string, text string, full_text string, event_time timestamp, original_time string, time_status string, cwd string, "
    f"metadata {schema.METADATA_TYPE}, generation_id string, locator string, position long"
)


@dataclass
class Inputs:
    """What a refresh reads: (provider, root paths) pairs, tables and rules.

    most_statements: records of more statements yield none and are a gap; by default there is no limit.
    """

    transcripts: Sequence[tuple[str, Sequence[str]]] = ()
    documents: DataFrame | None = None
    chat: tuple[DataFrame, DataFrame] | None = None
    worktrees: DataFrame | None = None
    associations: DataFrame | None = None
    forgotten: DataFrame | None = None
    corrections: DataFrame | None = None
    exclusions: Sequence[str] = ()
    extra_patterns: tuple[str, ...] = ()
    glob: str = "*.jsonl*"
    most_statements: int | None = None
    chunk_bytes: int = ranges.CHUNK


class Store:
    """Snapshot-isolated tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self) -> DataFrame:
        return sinks.read_table(self.spark, f"{self.root}/refresh_runs", RUNS)

    def last_run(self) -> int:
        row = self.runs().agg(F.max("run_id").alias("n")).first()
        return row["n"] or 0

    def items_base(self) -> int:
        """The run of the last rebuild, which wrote the items of all records; earlier ones are history."""
        return self.runs().agg(F.max(F.col("stats")["items_base"]).alias("b")).first()["b"] or 0

    def rows(self, name: str) -> DataFrame:
        """Committed rows with their run_id; sources, marks and diagnostics are full snapshots of the last run."""
        last = self.last_run()
        rows = sinks.read_table(
            self.spark, f"{self.root}/{name}", TABLES[name] + ", run_id long"
        )
        if name in ("sources", "marks", "diagnostics"):
            rows = rows.filter(F.col("run_id") == last)
        else:
            rows = rows.filter((F.col("run_id") <= last) & ~F.col("run_id").isin(self.retired(name)))
        return rows.filter(F.col("run_id") >= self.items_base()) if name == "items" else rows

    def table(self, name: str) -> DataFrame:
        rows = self.rows(name).drop("run_id")
        if name == "generations":
            return identity.generation_status(rows.withColumn("status", F.lit("")))
        return rows

    def retired(self, name: str) -> list[int]:
        """Runs whose rows of a table were written anew without forgotten ones; at most one number a run."""
        if name == "retired":
            return []
        rows = self.table("retired").filter(F.col("name") == name)
        return sorted(r["retired_run"] for r in rows.select("retired_run").distinct().collect())

    def full_records(self) -> DataFrame:
        """Records with their whole redacted text as full_text; no source is opened."""
        texts = self.table("texts").select(F.col("digest").alias("_digest"), F.col("full_text").alias("_whole"))
        records = self.table("records")
        joined = records.join(texts, F.col("text_digest") == F.col("_digest"), "left")
        return joined.select(*records.columns, F.coalesce("_whole", "text").alias("full_text"))

    def write(self, name: str, df: DataFrame, run_id: int, *partition_by: str) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/run_id={run_id}")

    def write_texts(self, records: DataFrame, run_id: int) -> None:
        """Each whole text that a record's excerpt cuts, once, under its digest."""
        cut = records.filter("text_digest is not null").select(F.col("text_digest").alias("digest"), "full_text")
        fresh = cut.dropDuplicates(["digest"]).join(self.table("texts").select("digest"), "digest", "left_anti")
        self.write("texts", fresh.withColumn("bucket", F.substring("digest", 1, 1)), run_id, "bucket")

    def commit(self, row: DataFrame) -> None:
        row.write.mode("append").parquet(f"{self.root}/refresh_runs")


def forget_sessions(store: Store, sessions: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Remove sessions (session_id), and what hangs on their records, from every table; returns the report row.

    Only runs that hold such rows are written anew; their old folders are retired
    with the commit and can then be deleted (`purge`).  Whole texts go when no
    record points to them any more.  Memory, corrections and other records stay.
    excluded: sources (source_id) that become `excluded` and lose marks and gaps.
    """
    spark, run_id = store.spark, store.last_run() + 1
    started = spark.sql("select current_timestamp() as t").first()["t"]
    gone = session.stage(sessions.select("session_id").distinct(), "gone")
    removed = session.stage(store.table("records").join(gone, "session_id", "left_semi").select("record_id"), "removed")
    kept_texts = store.table("records").join(gone, "session_id", "left_anti").filter("text_digest is not null").select(F.col("text_digest").alias("digest"))
    orphans = session.stage(store.table("texts").select("digest").join(kept_texts, "digest", "left_anti"), "orphans")
    retired: list[tuple[str, int]] = []
    for name, key, lost in (("records", "record_id", removed), ("occurrences", "record_id", removed), ("items", "record_id", removed), ("texts", "digest", orphans)):
        rows = store.rows(name)
        hit = [r["run_id"] for r in rows.join(lost, key, "left_semi").select("run_id").distinct().collect()]  # at most one a run
        if hit:
            kept = rows.filter(F.col("run_id").isin(hit)).join(lost, key, "left_anti").select(*_names(TABLES[name]))
            store.write(name, kept, run_id, *(["bucket"] if name == "texts" else []))
            retired += [(name, n) for n in hit]
    store.write("retired", spark.createDataFrame(retired, TABLES["retired"]), run_id)
    out = excluded.select("source_id").distinct() if excluded is not None else spark.createDataFrame([], "source_id string")
    out = session.stage(out, "excluded")
    for name in ("marks", "diagnostics"):
        store.write(name, store.table(name).join(out, "source_id", "left_anti"), run_id)
    marked = store.table("sources").join(out.withColumn("_out", F.lit(True)), "source_id", "left")
    status = F.when(F.col("_out"), "excluded").otherwise(F.col("status"))
    store.write("sources", marked.withColumn("status", status).select(*_names(TABLES["sources"])), run_id)
    stats = {"forgotten": removed.count(), "excluded": out.count()}
    base = store.items_base()
    if base:
        stats["items_base"] = base
    return _commit(store, run_id, started, "passed", stats)


def exclude_sources(store: Store, glob: str) -> DataFrame:
    """Forget every session found in sources whose path or name matches; returns the report row."""
    regex = pathops.file_glob(glob)
    sources = store.table("sources").filter(F.col("path").rlike(regex) | pathops.base_name(F.col("path")).rlike(regex))
    sessions = evidence.sessions_of_sources(
        store.table("records"), store.table("occurrences"), store.table("generations"), store.table("sources"), glob
    )
    return forget_sessions(store, sessions, sources)


def purge(store: Store) -> int:
    """Delete the folders of retired runs; returns how many.  No reader may hold an older snapshot."""
    jvm, gone = store.spark.sparkContext._jvm, 0
    for row in store.table("retired").distinct().collect():
        target = jvm.org.apache.hadoop.fs.Path(f"{store.root}/{row['name']}/run_id={row['retired_run']}")
        gone += bool(target.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def _commit(store: Store, run_id: int, started, status: str, stats: dict[str, int]) -> DataFrame:
    pairs = [F.lit(x).cast("string" if i % 2 == 0 else "long") for kv in stats.items() for i, x in enumerate(kv)]
    store.commit(
        store.spark.range(1).select(
            F.lit(run_id).cast("long").alias("run_id"), F.lit(started).alias("started_at"),
            F.current_timestamp().alias("ended_at"), F.lit(status).alias("status"), F.lit(PIPELINE).alias("pipeline"),
            F.create_map(*pairs).alias("stats"),
        )
    )
    return store.runs().filter(F.col("run_id") == run_id)


def text_digest() -> F.Column:
    """Digest of the whole text where the excerpt is not the whole text."""
    return F.when(F.col("full_text") != F.col("text"), F.sha2("full_text", 256))


def _packed_lines(spark: SparkSession, changes: DataFrame, provider: str) -> DataFrame | None:
    """Lines of changed compressed files, which are read whole; a scan needs its file list on the driver."""
    rows = changes.filter((F.col("provider") == provider) & F.col("reads") & _packed("path"))
    paths = [r["path"] for r in rows.select("path").toLocalIterator()]
    return transcripts.read_transcripts(spark, paths, compressed=True, glob="*") if paths else None


def _packed(path: str) -> F.Column:
    return F.col(path).endswith(".zst")


def _measured(listing: DataFrame, prior: DataFrame, known: DataFrame, inputs: Inputs) -> DataFrame:
    """Chunks of new and changed files, read once for counts and digests."""
    first = manifest.classify_sources(prior, listing).filter(F.col("change").isin("new", "replaced"))
    seen = known.select(F.col("source_id"), F.col("byte_offset").alias("seen"))
    files = first.join(seen, "source_id", "left").filter(~_packed("path")).select(
        F.col("path").alias("source_path"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "length"
    )
    return session.stage(ranges.measured(ranges.chunked(files, inputs.chunk_bytes)), "measured")


def refresh(spark: SparkSession, root: str, inputs: Inputs, rebuild: bool = False) -> DataFrame:
    """Run once and return the report row.

    Of an appended file the known prefix is verified by its bytes and only the lines
    behind it are parsed.  A changed pipeline version implies a rebuild: all items
    are derived anew from the stored records and whole texts, no source being opened
    for it, with explicit corrections carried over.  A file that cannot be read is
    failed and keeps what it had; the others go on.
    """
    store = Store(spark, root)
    rebuild = rebuild or needs_reextraction(store)
    run_id = store.last_run() + 1
    started = spark.sql("select current_timestamp() as t").first()["t"]
    prior = session.stage(store.table("sources"), "prior")
    known = session.stage(store.table("marks"), "marks")

    listing = None
    for provider, roots in inputs.transcripts:
        part = manifest.build_manifest(spark, roots, provider, inputs.glob)
        listing = part if listing is None else listing.unionByName(part)
    empty_listing = spark.createDataFrame([], "provider string, path string, length long, modified_at timestamp")
    listing = empty_listing if listing is None else listing
    listing = listing.filter(transcripts.allowed_path(F.col("path"), inputs.exclusions))
    file_prior = prior.filter(F.col("provider").isin([p for p, _ in inputs.transcripts] or [""]))
    chunks = _measured(listing, file_prior, known, inputs)
    ends = session.stage(ranges.marks(chunks), "ends")
    verified = ends.filter("seen_hash is not null").select("source_path", F.col("seen_hash").alias("prefix_hash"))
    classified = manifest.classify_sources(file_prior, listing, verified)
    broken = ends.filter("error is not null").select(F.col("source_path").alias("path"), F.lit(True).alias("_failed"))
    classified = classified.join(broken, "path", "left").withColumn("change", F.when(F.col("_failed"), "failed").otherwise(F.col("change"))).drop("_failed")
    before = known.select("source_id", F.col("byte_offset").alias("_offset"), "context")
    ruled_out = (F.col("change") == "missing") & ~transcripts.allowed_path(F.col("path"), inputs.exclusions)
    gone_by_rule = ruled_out | ((F.col("change") == "missing") & (F.col("prior_status") == "excluded"))
    classified = classified.withColumn("change", F.when(gone_by_rule, "excluded").otherwise(F.col("change")))
    changes = manifest.next_generation(classified).join(before, "source_id", "left").withColumns(
        {"from_offset": F.when(F.col("from_line") > 0, F.col("_offset")).otherwise(F.lit(0)).cast("long"),
         "context": F.when(F.col("from_line") > 0, F.col("context"))}
    ).drop("_offset")
    changes = session.stage(changes, "changes")

    events, packed_marks, contexts = None, None, None
    for provider, _ in inputs.transcripts:
        own = changes.filter((F.col("provider") == provider) & F.col("reads"))
        due = own.filter(~_packed("path")).select(F.col("path").alias("source_path"), "from_offset", F.col("from_line").alias("from_line"), "context")
        sides = []
        if due.limit(1).count():
            # Written once, for numbering, headers and carried context each pass over the lines.
            lines = session.stage(ranges.read_lines(chunks, due.drop("context")), "lines")
            sides.append((lines, due.select("source_path", "context")))
        packed = _packed_lines(spark, changes, provider)
        if packed is not None:
            sides.append((packed, None))
            prefix = manifest.prefix_digests(packed)
            packed_marks = prefix if packed_marks is None else packed_marks.unionByName(prefix)
        for lines, prior_context in sides:
            parsed = transcripts.parse_lines(lines)
            part = normalize.normalize(provider, parsed, prior_context)
            events = part if events is None else events.unionByName(part)
            if prior_context is not None:
                part = normalize.contexts(provider, parsed.filter("not coalesce(code in ('incomplete_tail', 'oversized_incomplete_tail'), false)"), prior_context)
                contexts = part if contexts is None else contexts.unionByName(part)
    digests = ends.filter("error is null").join(changes.filter("reads").select(F.col("path").alias("source_path"), "from_line"), "source_path").select(
        "source_path", (F.col("from_line") + F.when(F.col("from_line") > 0, F.col("later")).otherwise(F.col("lines"))).alias("line"), "prefix_hash"
    )
    if packed_marks is not None:
        digests = digests.unionByName(packed_marks)

    null = F.lit(None).cast("string")
    parts, problems = [], []
    if events is not None:
        fresh = changes.filter("reads").select(
            F.col("path").alias("_path"), "source_id", "generation"
        )
        due = events.join(fresh, F.col("source_path") == F.col("_path"))
        staged = session.stage(due.drop("_path"), "events")
        found = normalize.records_of(staged, inputs.extra_patterns, keep=("source_id", "generation"))
        parts.append(
            found.withColumn(
                "generation_id", F.concat_ws("/", "source_id", F.col("generation").cast("string"))
            ).withColumn("position", F.col("line_no"))
        )
        problems.append(staged.filter("code is not null").select("source_id", "code", "message", "locator", "line_no"))
    problems.append(
        ends.filter("error is not null").join(changes.select(F.col("path").alias("source_path"), "source_id"), "source_path").select(
            "source_id", F.lit(UNREADABLE).alias("code"), F.col("error").alias("message"), null.alias("locator"), F.lit(None).cast("long").alias("line_no")
        )
    )
    extra_sources = []
    if inputs.documents is not None:
        sections, source_rows, gaps = _document_parts(store, prior, inputs, run_id)
        parts.append(sections)
        extra_sources.append(source_rows)
        problems.append(gaps)
    if inputs.chat is not None:
        messages, source_rows, gaps = _chat_parts(prior, inputs, run_id)
        parts.append(messages)
        extra_sources.append(source_rows)
        problems.append(gaps)

    stats = {"sources": changes.filter("change not in ('missing', 'excluded')").count()}
    for name in ("unchanged", "missing", "excluded", "failed"):
        stats[name] = changes.filter(F.col("change") == name).count()
    columns = [
        "record_id", "session_id", "session_native_id", "native_id", "provider", "actor", "kind", "text",
        "full_text", "event_time", "original_time", "time_status", "cwd", "metadata", "generation_id",
        "locator", "position",
    ]
    occurring = spark.createDataFrame([], OCCURRING) if rebuild else None
    for part in parts:
        chosen = part.select(*columns)
        occurring = chosen if occurring is None else occurring.unionByName(chosen)
    fresh_gaps = None
    if occurring is not None:
        occurring = session.stage(occurring, "occurring")
        stats["parsed"] = occurring.count()
        stats["forgotten"] = 0
        if inputs.forgotten is not None:
            stats["forgotten"] = identity.forgotten_records(occurring, inputs.forgotten).count()
            occurring = identity.without_forgotten(occurring, inputs.forgotten)
        fresh_gaps = _write_records(store, occurring, inputs, run_id, stats, rebuild)
    stats.setdefault("parsed", 0)
    stats.setdefault("inserted", 0)
    if fresh_gaps is not None:
        problems.append(fresh_gaps)

    _write_sources(store, prior, changes, digests, extra_sources, problems, run_id)
    _write_marks(store, known, changes, ends, contexts, run_id)
    written = store.spark.read.schema(TABLES["sources"]).parquet(f"{root.rstrip('/')}/sources/run_id={run_id}")
    stats["partial"] = written.filter("status = 'partial'").count()
    status = "partial" if stats["partial"] or stats["missing"] or stats["failed"] else "passed"
    return _commit(store, run_id, started, status, stats)


def _write_records(
    store: Store, occurring: DataFrame, inputs: Inputs, run_id: int, stats: dict, rebuild: bool
) -> DataFrame | None:
    spark = store.spark
    known = store.table("records").select(F.col("record_id").alias("_known"))
    seen = identity.distinct_records(
        occurring, [c for c in occurring.columns if c not in ("generation_id", "locator", "position")]
    ).join(known, F.col("record_id") == F.col("_known"), "left_anti")
    worktrees = inputs.worktrees if inputs.worktrees is not None else spark.createDataFrame([], schema.WORKTREES)
    new = session.stage(assoc.associate(seen, worktrees, inputs.associations).withColumn("text_digest", text_digest()), "new-records")
    stats["inserted"] = new.count()
    store.write_texts(new, run_id)
    store.write("records", new.select(*_names(TABLES["records"])), run_id)
    if rebuild:
        new = session.stage(store.full_records().unionByName(new.select(*_names(TABLES["records"]), "full_text")), "all-records")
    occurrences = identity.distinct_occurrences(occurring)
    old = store.table("occurrences").select("record_id", "generation_id", "locator")
    store.write(
        "occurrences", occurrences.join(old, ["record_id", "generation_id", "locator"], "left_anti"), run_id
    )
    meta = F.col("metadata")
    shaped = new.select(
        "record_id", "provider", "actor", "kind", "full_text", meta["tool"].alias("tool"),
        meta["section"].alias("section"), meta["relative_path"].alias("relative_path"),
        meta["line_start"].alias("line_start"), meta["source_context"].alias("source_context"),
    )
    found = session.stage(
        extract.statements(shaped).unionByName(docs.document_statements(shaped)), "statements"
    )
    items = resolve.with_scope(extract.number_items(found, inputs.most_statements), new).select(*_names(ITEMS))
    if rebuild:
        before = store.table("items")
        if inputs.corrections is not None:
            store.write("corrections", identity.carry_overrides(before, items, inputs.corrections), run_id)
        stats["items_base"] = run_id
    store.write("items", items, run_id)
    principles = extract.proposed_principles(extract.number_items(found, inputs.most_statements), new, F.current_timestamp())
    memory = store.table("memory").select("memory_id")
    store.write("memory", principles.join(memory, "memory_id", "left_anti"), run_id)
    if inputs.most_statements is None:
        return None
    gaps = extract.extraction_gaps(found, inputs.most_statements)
    # An over-full record is a gap of every source that holds it.
    return gaps.join(occurrences, "record_id").select(
        F.regexp_replace("generation_id", r"/\d+$", "").alias("source_id"), "code",
        F.lit(None).cast("string").alias("message"), "locator", F.col("position").alias("line_no"),
    )


def _names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    names, depth, token = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            names.append(token.strip().split(" ")[0])
            token = ""
        else:
            token += c
    return names


def _write_sources(store, prior, changes, digests, extra_sources, problems, run_id) -> None:
    spark = store.spark
    null = F.lit(None).cast("string")
    empty = spark.createDataFrame([], TABLES["diagnostics"])
    fresh = empty
    for part in problems:
        fresh = fresh.unionByName(part)
    # Gaps of complete lines stay until that part is verified again; tails are re-judged.
    kept = store.table("diagnostics").filter(~F.col("code").isin("incomplete_tail", "oversized_incomplete_tail", UNREADABLE)).join(
        changes.filter(F.col("change").isin("appended", "unchanged", "missing", "excluded", "reread", "failed")).select("source_id"),
        "source_id", "left_semi",
    )
    tails = store.table("diagnostics").filter(F.col("code").isin("incomplete_tail", "oversized_incomplete_tail")).join(
        changes.filter("change = 'unchanged'").select("source_id"), "source_id", "left_semi"
    )
    diagnostics = session.stage(fresh.unionByName(kept).unionByName(tails), "diagnostics")
    store.write("diagnostics", diagnostics, run_id)
    broken = diagnostics.select(F.col("source_id").alias("_bad")).distinct()
    marks = digests
    old = prior.select(
        F.col("source_id").alias("_old"), F.col("line").alias("_old_line"),
        F.col("prefix_hash").alias("_old_hash"), F.col("last_refresh").alias("_old_refresh"),
    )
    marks = marks.withColumnRenamed("line", "_line").withColumnRenamed("prefix_hash", "_hash")
    read = F.col("reads")
    rows = (
        changes.join(marks, F.col("path") == F.col("source_path"), "left")
        .join(old, F.col("source_id") == F.col("_old"), "left")
        .join(broken, F.col("source_id") == F.col("_bad"), "left")
        .select(
            "source_id", "provider", "path", null.alias("fingerprint"), "length", "modified_at",
            F.when(F.col("change").isin("missing", "excluded", "failed"), F.col("change")).when(F.col("_bad").isNotNull(), "partial").otherwise("ready").alias("status"),
            "generation",
            F.when(read, F.coalesce("_line", F.lit(0))).otherwise(F.col("_old_line")).cast("long").alias("line"),
            F.when(read, F.col("_hash")).otherwise(F.col("_old_hash")).alias("prefix_hash"),
            F.when(read, F.current_timestamp()).otherwise(F.col("_old_refresh")).alias("last_refresh"),
        )
    )
    for part in extra_sources:
        rows = rows.unionByName(part)
    rows = session.stage(rows, "sources")
    store.write("sources", rows, run_id)
    known = store.table("generations").select("source_id", "number")
    new = rows.filter("generation > 0").select("source_id", F.col("generation").alias("number")).join(
        known, ["source_id", "number"], "left_anti"
    )
    store.write(
        "generations",
        new.select(F.concat_ws("/", "source_id", F.col("number").cast("string")).alias("generation_id"), "source_id", "number"),
        run_id,
    )


def _write_marks(store: Store, known: DataFrame, changes: DataFrame, ends: DataFrame, contexts: DataFrame | None, run_id: int) -> None:
    """Where the next run starts in each file, and the context carried to there."""
    shape = _names(TABLES["marks"])
    rows = known.join(changes.filter("reads").select("source_id"), "source_id", "left_anti").select(*shape)
    if contexts is not None:
        read = changes.filter("reads").select("source_id", F.col("path").alias("source_path"), F.col("context").alias("_before"))
        done = read.join(ends, "source_path").join(contexts, "source_path", "left")
        rows = rows.unionByName(done.select("source_id", "byte_offset", F.coalesce("context", "_before").alias("context")))
    store.write("marks", rows, run_id)


def _document_parts(store: Store, prior: DataFrame, inputs: Inputs, run_id: int):
    """Section records of new or changed documents, source rows, and gaps."""
    null = F.lit(None).cast("string")
    before = prior.filter(F.col("provider") == P.PROVIDER_DOCUMENT).select(
        F.col("source_id").alias("_sid"), F.col("fingerprint").alias("_print"), F.col("generation").alias("_gen")
    )
    path = F.concat_ws("/", "root_path", "relative_path")
    seen = session.stage(
        inputs.documents.drop("content").join(before, F.col("document_id") == F.col("_sid"), "full_outer").withColumn(
            "_same", F.coalesce(F.col("fingerprint") == F.col("_print"), F.lit(False))
        ),
        "documents",
    )
    present = seen.filter("document_id is not null")
    generation = F.when(F.col("_same"), F.col("_gen")).otherwise(F.coalesce("_gen", F.lit(0)) + 1).cast("int")
    usable = present.filter("code is null").withColumn("generation", generation)
    changed = usable.filter("not _same")
    sections = docs.section_records(changed, F.current_timestamp()).join(
        changed.select(F.col("document_id").alias("session_native_id"), "generation"), "session_native_id"
    ).withColumn(
        "generation_id", F.concat_ws("/", "session_native_id", F.col("generation").cast("string"))
    ).withColumn("position", F.col("line_no"))
    rows = present.withColumn("generation", F.when(F.col("code").isNull(), generation).otherwise(F.coalesce("_gen", F.lit(0))).cast("int")).select(
        F.col("document_id").alias("source_id"), F.lit(P.PROVIDER_DOCUMENT).alias("provider"), path.alias("path"),
        "fingerprint", "length", F.col("modificationTime").alias("modified_at"),
        F.when(F.col("code").isNull(), "ready").otherwise("partial").alias("status"), "generation",
        F.lit(0).cast("long").alias("line"), null.alias("prefix_hash"), F.current_timestamp().alias("last_refresh"),
    )
    lost = prior.join(seen.filter("document_id is null").select(F.col("_sid").alias("source_id")), "source_id", "left_semi").withColumn(
        "status", F.lit("missing")
    )
    gaps = present.filter("code is not null").select(
        F.col("document_id").alias("source_id"), "code", null.alias("message"),
        F.col("relative_path").alias("locator"), F.lit(None).cast("long").alias("line_no"),
    )
    return sections, rows.unionByName(lost.select(*rows.columns)), gaps


def _chat_parts(prior: DataFrame, inputs: Inputs, run_id: int):
    """Chat rows: always a full replacement generation."""
    null = F.lit(None).cast("string")
    spark = prior.sparkSession
    events = normalize.normalize_chat(chatstore.read_message_store(*inputs.chat))
    source = spark.range(1).select(hashing.content_id(F.lit(P.PROVIDER_CHAT), F.lit("message_store")).alias("source_id"))
    sid = source.first()["source_id"]
    row = prior.filter(F.col("source_id") == sid).select("generation").first()
    number = (row["generation"] if row else 0) + 1
    records = normalize.records_of(events, inputs.extra_patterns).withColumn(
        "generation_id", F.lit(f"{sid}/{number}")
    ).withColumn("position", F.col("line_no"))
    gaps = normalize.diagnostics_of(events).select(F.lit(sid).alias("source_id"), "code", "message", "locator", "line_no")
    bad = gaps.limit(1).count() > 0
    rows = source.select(
        "source_id", F.lit(P.PROVIDER_CHAT).alias("provider"), F.lit("message_store").alias("path"),
        null.alias("fingerprint"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified_at"),
        F.lit("partial" if bad else "ready").alias("status"), F.lit(number).alias("generation"),
        F.lit(0).cast("long").alias("line"), null.alias("prefix_hash"), F.current_timestamp().alias("last_refresh"),
    )
    return records, rows, gaps


def needs_reextraction(store: Store) -> bool:
    """Whether stored items come from another pipeline version."""
    row = store.runs().agg(F.max_by("pipeline", "run_id").alias("p")).first()
    return row["p"] is not None and row["p"] != PIPELINE
