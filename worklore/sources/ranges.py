"""Byte ranges of files: digests of known prefixes, and lines from a stored offset on.

Files are cut into chunks at fixed places.  One pass over the bytes counts line
feeds and digests every chunk, so a prefix is verified and lines are numbered
without decoding them; a second one turns only the chunks behind the stored offset
into lines.  Both are tables of chunks in, rows out: no list of files reaches the
driver and no line is shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

CHUNK = 64 << 20
_BUFFER = 1 << 20
_MEASURED = (
    "source_path string, block long, stop long, seen long, length long, lines long, later long, "
    "last long, whole string, upto_last string, upto_seen string, error string"
)
_LINES = "source_path string, block long, line_no long, byte_offset long, value string, tail boolean"


def open_file(path: str) -> io.BufferedReader:
    """A file of any store that the workers' Arrow reaches, for reading."""
    store, place = _placed(path)
    return io.BufferedReader(store.open_input_file(place), _BUFFER)


def create_file(path: str) -> io.BufferedWriter:
    """A new file of any such store, for writing; its folders are made, an older file is replaced."""
    store, place = _placed(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return io.BufferedWriter(store.open_output_stream(place), _BUFFER)


def _placed(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """files (source_path, seen, length) -> one row per chunk, with block and stop added; empty files have none."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    cut = files.where("length > 0").select("source_path", F.explode(starts).alias("block"), "seen", "length")
    stop = F.least(F.col("block") + size, "length")
    # Dealt anew, for one small row stands for a whole chunk of bytes.
    return cut.select("source_path", "block", stop.alias("stop"), "seen", "length").repartition("source_path", "block")


def _measure(row: dict) -> dict:
    block, stop, seen = row["block"], row["stop"], row["seen"]
    out = {"lines": 0, "later": 0, "last": None, "whole": None, "upto_last": None, "upto_seen": None, "error": None}
    try:
        with open_file(row["source_path"]) as f:
            f.seek(block)
            whole, at = hashlib.sha256(), block
            while at < stop:
                part = f.read(min(_BUFFER, stop - at))
                if not part:
                    raise OSError("file is shorter than listed")
                feeds = part.count(b"\n")
                out["lines"] += feeds
                out["later"] += feeds if at >= seen else part.count(b"\n", seen - at) if seen < at + len(part) else 0
                if at < seen <= at + len(part):
                    upto = whole.copy()
                    upto.update(part[: seen - at])
                    out["upto_seen"] = upto.hexdigest()
                if feeds:
                    end = part.rfind(b"\n") + 1
                    upto = whole.copy()
                    upto.update(part[:end])
                    out["last"], out["upto_last"] = at + end, upto.hexdigest()
                whole.update(part)
                at += len(part)
            out["whole"] = whole.hexdigest()
    except OSError as e:
        out |= {"error": str(e)}
    return {**row, **out}


def measured(chunks: DataFrame) -> DataFrame:
    """Line feeds (all, and those from `seen` on), the end of the last whole line, and digests of every chunk.

    A chunk that cannot be read has an error in place of digests.
    """

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for row in batch.to_pylist():
                out = _measure(row)
                kinds = {"source_path": pa.string(), **{n: pa.string() for n in ("whole", "upto_last", "upto_seen", "error")}}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], kinds.get(n, pa.int64())) for n, v in out.items()], list(out)
                )

    return chunks.mapInArrow(run, _MEASURED)


def _joined_digest(which: str) -> F.Column:
    """Digest of chunk digests in order; `which` is null for chunks beyond the prefix."""
    parts = F.array_sort(F.collect_list(F.when(F.col(which).isNotNull(), F.struct("block", which))))
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(F.transform(parts, lambda p: p[which]), "-"), 256))


def marks(chunks: DataFrame) -> DataFrame:
    """(source_path, byte_offset, lines, later, prefix_hash, seen_hash, error) of measured files.

    byte_offset: end of the last whole line; prefix_hash: digest of the bytes before
    it; seen_hash: digest of the bytes before `seen`.
    """
    end = chunks.groupBy("source_path").agg(F.max("last").alias("byte_offset"))
    placed = chunks.join(end, "source_path")
    upto = F.when(F.col("stop") <= F.col("byte_offset"), F.col("whole")).when(F.col("block") < F.col("byte_offset"), F.col("upto_last"))
    known = F.when(F.col("stop") <= F.col("seen"), F.col("whole")).when(F.col("block") < F.col("seen"), F.col("upto_seen"))
    placed = placed.withColumns({"_new": upto, "_old": known})
    return placed.groupBy("source_path").agg(
        F.coalesce(F.max("byte_offset"), F.lit(0).cast("long")).alias("byte_offset"),
        F.sum("lines").alias("lines"), F.sum("later").alias("later"),
        _joined_digest("_new").alias("prefix_hash"), _joined_digest("_old").alias("seen_hash"),
        F.max("error").alias("error"),
    )


def read_lines(chunks: DataFrame, due: DataFrame) -> DataFrame:
    """Lines from an offset on, in the columns of `transcripts.read_transcripts`.

    chunks: as `measured`; due (source_path, from_offset, from_line): what is known
    already.  Bytes that are no UTF-8 are replaced.
    """
    later = chunks.join(due, "source_path").where(F.col("stop") > F.col("from_offset"))
    feeds = F.when(F.col("from_offset") > 0, F.col("later")).otherwise(F.col("lines"))
    before = W.partitionBy("source_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = later.withColumn("line", F.col("from_line") + F.coalesce(F.sum(feeds).over(before), F.lit(0)))
    start = F.greatest("block", "from_offset")
    plan = base.select(
        "source_path", "block", start.alias("start"), (start == F.col("from_offset")).alias("whole"), "stop", "length", "line"
    ).repartition("source_path", "block")

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for row in batch.to_pylist():
                yield from _lines_of(row)

    lines = plan.mapInArrow(run, _LINES)
    number, offset = F.col("line_no").cast("string"), F.col("byte_offset").cast("string")
    return lines.select(
        "source_path", "block", "line_no", "byte_offset", "value", F.concat(F.lit("line:"), number, F.lit("@"), offset).alias("locator"), "tail"
    )


def _lines_of(row: dict) -> Iterator[pa.RecordBatch]:
    at, number, stop, length = row["start"], row["line"], row["stop"], row["length"]
    numbers, offsets, values, tails, held = [], [], [], [], 0

    def batch() -> pa.RecordBatch:
        n = len(values)
        columns = [
            pa.array([row["source_path"]] * n), pa.array([row["block"]] * n, pa.int64()), pa.array(numbers, pa.int64()),
            pa.array(offsets, pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values]), pa.array(tails, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["source_path", "block", "line_no", "byte_offset", "value", "tail"])

    with open_file(row["source_path"]) as f:
        if not row["whole"]:  # the line that reaches into this chunk belongs to an earlier one
            f.seek(at - 1)
            skipped = len(f.readline()) - 1
            at, number = at + skipped, number + (skipped > 0)
        else:
            f.seek(at)
        while at < stop:
            raw = f.readline(length - at)
            if not raw:
                break
            number += 1
            ended = raw.endswith(b"\n")
            numbers.append(number)
            offsets.append(at)
            values.append(raw[:-1] if ended else raw)
            tails.append(not ended)
            at, held = at + len(raw), held + len(raw)
            if held > 4 * _BUFFER or len(values) >= 5000:
                yield batch()
                numbers, offsets, values, tails, held = [], [], [], [], 0
    if values:
        yield batch()
