"""Token ids as length-delimited binary records, with an offset index beside them.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4), a line feed.  All numbers are
little-endian.  A payload is one flag byte (low bits: bytes per id, bit 7: the
document has no id), doc_id (8 bytes), then the ids.  Checksums are CRC-32,
rotated and shifted so that a checksum of data holding checksums stays strong.

Records go through Spark's line writer: a task's file appears when the task is
committed, so lost executors leave no half files, and any store Spark can write
to will do.  Files in order of their numbers hold documents in order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from worklore.llm import wordcodes
from worklore.llm.textscan import batches

_FRAME = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_HEAD = struct.Struct("<Bq")
_NO_ID = 0x80
INDEX = "file string, file_no long, offset long, length long, doc_id long, n_tokens long, first long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record, without the line feed that the writer adds."""
    flag = width | (_NO_ID if doc_id is None else 0)
    payload = _HEAD.pack(flag, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = len(payload).to_bytes(8, "little")
    return size + _CHECK.pack(masked(size)) + payload + _CHECK.pack(masked(payload))


def unframe(data: memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids (unsigned 32-bit) and the place after the record at a place."""
    size, check = _FRAME.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at byte {at}")
    start, end = at + _FRAME.size, at + _FRAME.size + size
    payload = bytes(data[start:end])
    if len(data) <= end + 4 or masked(payload) != _CHECK.unpack_from(data, end)[0] or data[end + 4] != 10:
        raise ValueError(f"damaged record at byte {at}")
    flag, doc_id = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{flag & 15}", offset=_HEAD.size).astype("<u4")
    return None if flag & _NO_ID else doc_id, ids, end + 5


def write_records(
    df: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_bytes: int = 16 << 20
) -> None:
    """Write every document's ids, end_id last, in ascending doc_id order (null first).

    file_bytes: text bytes per file, about; a single longer text makes a longer
    file.  Equal doc_ids follow one another by text.  A null text has the end id
    alone.  Further columns are ignored.  An empty table gives an empty folder.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    vocabulary = wordcodes.encoder(tokenizer).library.get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4

    def framed(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = wordcodes.encoder(tokenizer)
        for batch in batches(arriving, "text"):
            ids, offsets = e.encode(batch.column("text").to_pylist())
            records = [
                frame(doc_id, np.append(ids[a:b], end_id), width)
                for doc_id, a, b in zip(
                    batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False
                )
            ]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    ordered = (
        df.select("doc_id", "text")
        .repartitionByRange(max(1, -(-total // file_bytes)), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    records = ordered.mapInArrow(framed, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "none").mode("errorifexists").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract("path", r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", 1).cast("long")
    piece = F.coalesce(F.regexp_extract("path", r"-c(\d+)\.txt$", 1).try_cast("long"), F.lit(0))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", (name * 1_000_000 + piece).alias("file_no"), "content")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its place, ids (binary, unsigned 32-bit) and checksum, verified.

    first counts the ids before it in its own file.
    """
    schema = T.StructType([*T._parse_datatype_string(INDEX).fields, T.StructField("ids", T.BinaryType())])

    def parsed(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in arriving:
            for path, file_no, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view, at, first, rows, held = memoryview(content), 0, 0, [], 0
                while at < len(view):
                    doc_id, ids, end = unframe(view, at)
                    raw = ids.tobytes()
                    rows.append((path, file_no, at, end - at, doc_id, len(ids), first, zlib.crc32(raw), raw))
                    at, first, held = end, first + len(ids), held + len(raw)
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return _files(spark, folder).mapInArrow(parsed, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 2), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Read all records back, write their offset index as a table, and return it."""
    places = read_records(spark, folder).drop("ids")
    places.write.mode("errorifexists").parquet(index)
    return spark.read.schema(places.schema).parquet(index)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before each record: a prefix over file totals."""
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file_no").withColumn("start", F.col("base") + F.col("first")).drop("base")


def fetch(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """doc_id and ids of the records that rows of the index name, a file's together."""
    wanted = places.groupBy("file_no").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def sliced(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for content, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(content)
                got = [unframe(view, at)[:2] for at in offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in got], pa.int64()), pa.array([i.tobytes() for _, i in got], pa.binary())],
                    ["doc_id", "ids"],
                )

    files = _files(spark, folder).join(wanted, "file_no").select("content", "offsets")
    return files.mapInArrow(sliced, "doc_id long, ids binary")


def read_shuffled(spark: SparkSession, folder: str, index: DataFrame, seed: int, parts: int) -> list[DataFrame]:
    """Records in a seeded random order, as parts to be read one after another.

    A record's part and its place in the part follow from a hash of its place.
    """
    key = F.xxhash64(F.lit(seed), "file_no", "offset")
    return [
        fetch(spark, folder, index.where(F.pmod(key, F.lit(parts)) == part)).orderBy(
            F.xxhash64(F.lit(seed), "doc_id", "ids")
        )
        for part in range(parts)
    ]
