"""Best-fit packing of documents into sequences of bounded length.

Documents are sorted by length over the cluster, which gives each its rank among
the documents of its length.  Rounds then go from the longest length to the
shortest.  In a round all documents of a length are matched at once: a sweep
starts at the successor of the length among the sorted gaps and goes on to larger
gaps; of documents that want the same gap the lowest ranks get it; the gaps
shrink, and documents left over open new sequences.  Documents and gaps of equal
size are interchangeable, so a sweep works on runs (a size, how many, the first
sequence number).  There are at most `capacity` sizes whatever the corpus, so the
runs stay small, and the rounds need only the count of documents per length; the
documents themselves are ranked and placed in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from worklore import session
from worklore.llm import wordcodes
from worklore.llm.joins import sized
from worklore.llm.textscan import batches


def sweep_rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Segments (length, first rank, how many, first sequence, per sequence, fill).

    The documents of a length with ranks from first rank on go to consecutive
    sequences from first sequence on, `per sequence` to each, above `fill`.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    segments: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = gap // length
            whole = min(n, left // per)
            taken = whole * per
            if taken:
                segments.append((length, rank, taken, first, per, capacity - gap))
                free(gap - per * length, first, whole)
            rest = min(left - taken, per) if whole < n else 0
            if rest:
                segments.append((length, rank + taken, rest, first + whole, rest, capacity - gap))
                free(gap - rest * length, first + whole, 1)
            free(gap, first + whole + bool(rest), n - whole - bool(rest))
            rank, left = rank + taken + rest, left - taken - rest
    return np.array(segments, np.int64).reshape(-1, 6)


def best_fit(df: DataFrame, capacity: int, *keys: str, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to every row of df; no sequence exceeds capacity.

    keys: columns that order rows of equal length; rows equal in all are
    interchangeable.  Lengths run from 1 to capacity, others raise an error.
    Columns named sequence_id and offset are replaced.  df is computed once.
    """
    df = df.drop("sequence_id", "offset")
    placed = T.StructType(
        [*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]
    )

    def numbered(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in arriving:
            parts = pa.array(np.full(batch.num_rows, part), pa.int32())
            places = pa.array(np.arange(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield batch.append_column("part", parts).append_column("place", places)

    ranked = session.stage(
        df.repartitionByRange(length, *keys).sortWithinPartitions(length, *keys).mapInArrow(numbered, placed), "ranked"
    )
    sizes = ranked.groupBy(length).count()
    if sizes.where(F.col(length).isNull() | ~F.col(length).between(1, capacity)).limit(1).count():
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    counts = {row[0]: row[1] for row in sizes.collect()}  # at most `capacity` rows
    segments = sweep_rounds(counts, capacity)
    below = np.cumsum([0, *(counts[k] for k in sorted(counts))])
    starts = dict(zip(sorted(counts), below.tolist(), strict=False))
    segments = segments[np.argsort(firsts := segments[:, 1] + np.array([starts[k] for k in segments[:, 0].tolist()], np.int64))]
    firsts = np.sort(firsts)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranked.groupBy("part").agg(F.count("*").alias("rows"))
    bases = bases.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    ordered = ranked.join(bases, "part").withColumn("place", F.col("base") + F.col("place")).drop("part", "base")
    final = T.StructType(
        [*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    names = df.columns

    def assigned(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            place = batch.column("place").to_numpy()
            segment = np.searchsorted(firsts, place, "right") - 1
            size, _, _, first, per, fill = segments[segment].T
            nth = place - firsts[segment]
            out = [*(batch.column(n) for n in names), pa.array(first + nth // per), pa.array(fill + nth % per * size)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ordered.mapInArrow(assigned, final)


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document cut at capacity ids.

    A document's ids end with end_id; a null text has that id alone.  key is a
    number of each row, good for the rows of one computation.
    keep_ids: adds ids, binary little-endian unsigned 32-bit.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, key long" + ", ids binary" * keep_ids

    def cut(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, key = wordcodes.encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches(arriving, "text"):
            ids, offsets = e.encode(batch.column("text").to_pylist())
            rows = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                own = np.append(ids[a:b], end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    raw = own[start : start + capacity].tobytes()
                    rows.append((doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), key, raw)[: 6 + keep_ids])
                    key += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return df.select("doc_id", "text").mapInArrow(cut, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """`pieces` of every document, each placed in a sequence by `best_fit`.

    The pieces are staged, so texts are encoded once and ids are never sorted:
    lengths are packed, and the places come back to the pieces by key.
    """
    cut = session.stage(pieces(df, tokenizer, capacity, end_id, keep_ids), "pieces")
    placed = best_fit(cut.drop("ids"), capacity, "doc_id", "piece")
    if not keep_ids:
        return placed.drop("key")
    places = sized(session.stage(placed.select("key", "sequence_id", "offset"), "places"))
    return cut.join(places, "key").drop("key")
