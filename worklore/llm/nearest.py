"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance: vectors are divided by the largest
norm and get one more component that makes them unit; queries are made unit.  A
table hashes a vector by `functions` Gaussian projections, shifted and cut into
steps of `width`; the tuple of steps is its bucket.  A query visits buckets in
order of estimated success, that is of rising squared distance from its own
projections to the bucket's box, its own bucket first and then perturbed ones,
until the visited buckets of a table hold a share of all vectors.  Candidates of
all tables are merged and ranked by exact inner products.

Vectors of near buckets share blocks of bounded size, a bucket with more vectors
than that is spread over several, and a block meets the queries that visit one of
its buckets.  The bucket counts, at most STEPS ** functions per table whatever
the number of vectors, are all that is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from worklore import session

STEPS = 5
_BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, norm) of rows that take part, all of one length.

    Null ids, null, empty and zero vectors and those with null or non-finite
    components take no part; the length is the most frequent one.
    """
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.where("vec_id is not null").where(~F.coalesce(bad, F.lit(True))).select("vec_id", vector.alias("embedding"), norm.alias("norm"))
    rows = session.stage(rows.where("norm > 0"), "vectors")
    length = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (length["size"] if length else 0))


def _boxes(query: np.ndarray, cells: np.ndarray, width: float) -> np.ndarray:
    """Squared distance of every query's projections to every cell's box; the outer steps are open."""
    out = np.zeros((len(query), len(cells)))
    for d in range(cells.shape[1]):
        low = np.where(cells[:, d] <= -(STEPS // 2), -np.inf, cells[:, d] * width)
        high = np.where(cells[:, d] >= STEPS // 2, np.inf, (cells[:, d] + 1) * width)
        q = query[:, d : d + 1]
        out += np.maximum(0, np.maximum(low - q, q - high)) ** 2
    return out


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    tables: int = 3,
    functions: int = 8,
    width: float = 2.0,
    share: float = 0.4,
    least: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for ids divisible by `every`.

    share: of all vectors, visited by a query in each table; `least` at least.
    Equal scores rank by vec_id; rows with the query's id are not candidates, and
    rows that repeat an id and its score count once.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = rows.select(F.size("embedding").alias("n")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], result)
    size = first["n"]
    largest, total = rows.agg(F.max("norm"), F.count("*")).first()
    draw = np.random.default_rng(seed)
    planes = draw.normal(size=(tables, size + 1, functions))
    shifts = draw.uniform(0, width, size=(tables, functions))

    def hashed(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding")) / largest
            x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])
            for t in range(tables):
                steps = np.clip(np.floor((x @ planes[t] + shifts[t]) / width), -(STEPS // 2), STEPS // 2).astype(np.int8)
                raw = steps.tobytes()
                cells = pa.array([raw[i * functions : (i + 1) * functions] for i in range(len(x))], pa.binary())
                out = [pa.array(np.full(len(x), t), pa.int32()), cells, batch.column("vec_id"), batch.column("embedding")]
                yield pa.RecordBatch.from_arrays(out, ["tbl", "cell", "vec_id", "embedding"])

    index = session.stage(rows.mapInArrow(hashed, "tbl int, cell binary, vec_id long, embedding array<double>"), "index")
    held = index.groupBy("tbl", "cell").count().collect()  # at most tables * STEPS ** functions rows
    directory = []
    for t in range(tables):
        own = sorted((bytes(r["cell"]), r["count"]) for r in held if r["tbl"] == t)
        counts = np.array([c for _, c in own], np.int64)
        below = np.cumsum(counts) - counts
        block = below // _BLOCK
        cells = np.frombuffer(b"".join(c for c, _ in own), np.int8).reshape(-1, functions)
        directory.append((cells, counts, block, np.maximum(1, -(-counts // _BLOCK))))
    places = [{cells[i].tobytes(): (int(block[i]), int(spread[i])) for i in range(len(cells))} for cells, _, block, spread in directory]
    target = max(share * total, least)
    query_blocks = max(1, -(-total // (every * _BLOCK)))

    def probes(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = _matrix(part.column("embedding"))
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                ids = part.column("vec_id").to_pylist()
                out: list[tuple] = []
                for t, (cells, counts, block, spread) in enumerate(directory):
                    f = unit @ planes[t][:size] + shifts[t]
                    scores = _boxes(f, cells, width)
                    for i, vec_id in enumerate(ids):
                        by = np.argsort(scores[i], kind="stable")
                        enough = min(len(by) - 1, int(np.searchsorted(np.cumsum(counts[by]), target)))
                        limit = scores[i][by[enough]]
                        seen = scores[i] <= limit
                        hit = set(block[seen].tolist())
                        for b, s in zip(block[seen & (spread > 1)].tolist(), spread[seen & (spread > 1)].tolist(), strict=True):
                            hit.update(range(b, b + s))
                        raw = (f[i].tobytes(), float(limit), x[i].tobytes())
                        out += [(t, b, vec_id // every % query_blocks, vec_id, *raw) for b in sorted(hit)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["tbl", "block", "part", "query_id", "projected", "upto", "query"])

    def placed(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            homes = [places[t][c] for t, c in zip(batch.column("tbl").to_pylist(), batch.column("cell").to_pylist(), strict=True)]
            ids = batch.column("vec_id").to_numpy()
            b = np.array([h[0] for h in homes], np.int64) + ids % np.array([h[1] for h in homes], np.int64)
            for part in range(query_blocks):
                out = [batch.column("tbl"), pa.array(b), pa.array(np.full(len(b), part), pa.int64()), batch.column("cell"), batch.column("vec_id"), batch.column("embedding")]
                yield pa.RecordBatch.from_arrays(out, ["tbl", "block", "part", "cell", "vec_id", "embedding"])

    def best(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((ids, -scores))[:k]

    def met(key: tuple, stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and asked.num_rows:
            x, ids = _matrix(stored.column("embedding")), stored.column("vec_id").to_numpy()
            steps = np.frombuffer(b"".join(stored.column("cell").to_pylist()), np.int8).reshape(-1, functions)
            cells, which = np.unique(steps, axis=0, return_inverse=True)
            which = which.reshape(-1)
            for at in range(0, asked.num_rows, 128):
                part = asked.slice(at, 128)
                f = np.frombuffer(b"".join(part.column("projected").to_pylist())).reshape(-1, functions)
                q = np.frombuffer(b"".join(part.column("query").to_pylist())).reshape(-1, size)
                own = part.column("query_id").to_numpy()
                visited = (_boxes(f, cells, width) <= part.column("upto").to_numpy()[:, None])[:, which]
                rough = np.where(visited & (ids[None, :] != own[:, None]), q @ x.T, -np.inf)
                for i in range(len(q)):
                    some = np.flatnonzero(rough[i] > -np.inf)
                    if len(some) > k:
                        edge = np.partition(rough[i][some], len(some) - k)[len(some) - k]
                        some = some[rough[i][some] >= edge - 1e-9 * (1 + abs(edge))]
                    if len(some):
                        exact = (x[some] * q[i]).sum(1)
                        top = best(ids[some], exact)
                        out.append((int(own[i]), ids[some][top].astype("<i8").tobytes(), exact[top].tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "vec_ids", "scores"])

    def ranked(key: tuple, found: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(found.column("vec_ids").to_pylist()), "<i8")
        scores = np.frombuffer(b"".join(found.column("scores").to_pylist()))
        pairs = np.unique(np.rec.fromarrays([ids, scores]))
        ids, scores = pairs.f0, pairs.f1
        top = best(ids, scores)
        n = len(top)
        columns = [pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.arange(1, n + 1), pa.int32()), pa.array(ids[top]), pa.array(scores[top])]
        return pa.Table.from_arrays(columns, ["query_id", "rank", "vec_id", "score"])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding").mapInArrow(
        probes, "tbl int, block long, part long, query_id long, projected binary, upto double, query binary"
    )
    stored = index.mapInArrow(placed, "tbl int, block long, part long, cell binary, vec_id long, embedding array<double>")
    keys = ["tbl", "block", "part"]
    found = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(met, "query_id long, vec_ids binary, scores binary")
    return found.groupBy("query_id").applyInArrow(ranked, result)
