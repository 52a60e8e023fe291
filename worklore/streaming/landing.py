"""Continuous ingest of transcript files that land whole, in two streams.

`arrive` reads each file in one micro-batch, so its context is complete, and writes
what it holds: rows, occurrences and gaps.  `publish` follows those rows, lets each
record through once, and derives its items.  Which records were seen is keyed state
that expires with the landing times, so neither its size nor what a batch reads
grows with history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema, session
from ..operators import associate, docs, extract, identity, normalize, resolve
from ..sources import transcripts

ARRIVED = schema.RECORDS + ", full_text string, landed_at timestamp"


def _names(table: str) -> list[str]:
    return [f.name for f in schema.fields(table)]


def arrive(
    spark: SparkSession, landing: str, output: str, checkpoint: str, provider: str,
    worktrees: DataFrame | None = None, files_per_trigger: int = 1000, glob: str = "*.jsonl",
) -> StreamingQuery:
    """Files to `output/arrived`, `output/occurrences` and `output/gaps`, a folder per batch.

    A batch writes its own folders over, so replaying it after a failure changes
    nothing.  landed_at is the newest modification time of the batch's files.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("lineSep", "\n").format("text").load(landing)
        .select("value", "_metadata")
    )
    trees = worktrees if worktrees is not None else spark.createDataFrame([], schema.WORKTREES)

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{output}/{name}/batch_id={batch_id}")

        placed = session.stage(transcripts.place_lines(batch), "landed")
        newest = batch.agg(F.max("_metadata.file_modification_time")).first()[0]
        events = session.stage(normalize.normalize(provider, transcripts.parse_lines(placed)), "landed-events")
        put("gaps", events.filter("code is not null").select("source_path", "code", "message", "locator", "line_no"))
        rows = normalize.records_of(events)
        put("occurrences", rows.select("record_id", "source_path", "locator", F.col("line_no").alias("position")).distinct())
        once = identity.distinct_records(rows, [c for c in rows.columns if c not in ("source_path", "line_no", "locator")])
        known = associate.associate(once, trees).withColumn("landed_at", F.lit(newest))
        put("arrived", known.select(*_names(ARRIVED)))

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(spark: SparkSession, output: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Rows of `output/arrived` once each to `output/records`, and their statements to `output/items`.

    A copy of a record that lands more than `delay` after the first one is let through again.
    """
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields(ARRIVED))
    # Glob: the folders of batches, so that other writers' folders do not disturb.
    arrived = spark.readStream.schema(shape).parquet(f"{output}/arrived/batch_id=*")
    fresh = arrived.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["record_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        new = session.stage(batch, "published")
        meta = F.col("metadata")
        places = [meta[n].alias(n) for n in ("tool", "section", "relative_path", "line_start", "source_context")]
        shaped = new.select("record_id", "provider", "actor", "kind", "full_text", *places)
        found = extract.statements(shaped).unionByName(docs.document_statements(shaped))
        items = resolve.with_scope(extract.number_items(found), new)
        for name, rows in (("items", items), ("records", new)):
            rows.write.mode("overwrite").parquet(f"{output}/{name}/batch_id={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Dated records of a record stream once each, with bounded state."""
    return (
        stream.filter("event_time is not null").withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["record_id"])
    )
