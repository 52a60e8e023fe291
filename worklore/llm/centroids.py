"""Centroid clustering on whole numbers, with norm-of-sum bounds.

Every vector keeps a lower bound of its distance to each centroid and the round in
which that bound was exact.  Centroids of all rounds are retained, so a bound is
loosened by the norm of the centroid's total displacement since that round, which
is never more than the sum of its moves.  A centroid whose loosened bound does not
exceed the exact distance to the assigned one is measured again; all others cannot
win.  Bounds only decide what is measured: distances are whole numbers, so the
result is that of measuring everything.

The state (vector, cluster, bounds) is written to the shared folder once a round.
The driver sees k centroids and their sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from worklore import session

_LIMIT = 1 << 27  # of a component, so that any squared distance of up to 255 components fits a long
_EXACT = 1 << 21  # of a component, so that doubles hold such a distance exactly
_STATE = "vec_id long, q array<long>, cluster int, bounds binary, rounds binary, measured int"


def whole_vectors(vectors: DataFrame, size: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of vectors with `size` components, none null or non-finite.

    Other rows are left out.  A component of 2**27 or more makes the job fail, for
    distances would not fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.size("embedding") == size).where(~F.coalesce(bad, F.lit(True)))
    fits = F.forall(x, lambda v: F.abs(v * scale) < _LIMIT)
    q = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    checked = F.when(fits, q).otherwise(F.raise_error(F.lit("a component is too large for whole distances")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The vectors with the k smallest sha256 of `seed:vec_id`; of equal ids the smaller vectors, null ids never."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def _floor_means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum / count of every cluster; empty clusters keep their centroid."""
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per cluster
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return moved


def _measure(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = q.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - row) ** 2).sum(1) for row in c], 1)


def assign(q: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, since: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, exact squared distance) by the newest centroids; updates bounds and since.

    bounds[i, j]: exact distance (not squared) of row i to centroid j in round since[i, j].
    """
    now = len(history) - 1
    centroids = history[now]
    rows = np.arange(len(q))
    own = ((q - centroids[cluster]) ** 2).sum(1)
    bounds[rows, cluster], since[rows, cluster] = np.sqrt(own), now
    shift = np.stack([np.sqrt(((centroids - c) ** 2).sum(1).astype(float)) for c in history])  # (round, centroid)
    lower = bounds - shift[since, np.arange(len(centroids))]
    upper = np.sqrt(own)[:, None]
    open_ = lower <= upper * (1 + 1e-9) + 1e-6
    open_[rows, cluster] = False
    best, winner = own.copy(), cluster.copy()
    for j in range(len(centroids)):
        some = np.flatnonzero(open_[:, j])
        exact = ((q[some] - centroids[j]) ** 2).sum(1)
        bounds[some, j], since[some, j] = np.sqrt(exact), now
        wins = (exact < best[some]) | ((exact == best[some]) & (j < winner[some]))
        best[some[wins]], winner[some[wins]] = exact[wins], j
    return winner, best


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def _packed(x: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured of every kept vector.

    Fewer than k vectors with an id give as many clusters; none gives no rows.
    Repeated rows count as often as they occur; a null vec_id stays null, and its
    vector starts no cluster.  measured: distances to centroids computed in the
    last assignment, of k.  Sums and inertias
    beyond a long fail the job.
    """
    spark = vectors.sparkSession
    rows = session.stage(whole_vectors(vectors, size, scale), "whole")
    history = [first_centroids(rows, k)]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured int"
    if not len(history[0]):
        return spark.createDataFrame([], result)
    width = len(history[0])

    def start(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            if batch.num_rows:
                squared = _measure(_rows(batch), history[0])
                cluster = squared.argmin(1)
                yield made(batch, cluster, np.sqrt(squared), np.zeros(squared.shape, np.int8), np.full(len(cluster), width))

    def made(batch: pa.RecordBatch, cluster: np.ndarray, bounds: np.ndarray, since: np.ndarray, measured: np.ndarray) -> pa.RecordBatch:
        columns = [batch.column("vec_id"), batch.column("q"), pa.array(cluster, pa.int32()), _packed(bounds), _packed(since), pa.array(measured, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "cluster", "bounds", "rounds", "measured"])

    def step(past: list[np.ndarray]):
        def again(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arriving:
                if not batch.num_rows:
                    continue
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist())).reshape(-1, width).copy()
                since = np.frombuffer(b"".join(batch.column("rounds").to_pylist()), np.int8).reshape(-1, width).copy()
                cluster, _ = assign(_rows(batch), batch.column("cluster").to_numpy(), bounds, since, past)
                yield made(batch, cluster, bounds, since, (since == len(past) - 1).sum(1))

        return again

    state = session.stage(rows.mapInArrow(start, _STATE), "clusters")
    for _ in range(rounds):
        history.append(_floor_means(state, history[-1]))
        state = session.stage(state.mapInArrow(step(list(history)), _STATE), "clusters")
    last = history[-1]

    def distances(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            if batch.num_rows:
                exact = ((_rows(batch) - last[batch.column("cluster").to_numpy()]) ** 2).sum(1)
                columns = [batch.column("vec_id"), batch.column("cluster"), pa.array(exact), batch.column("measured")]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "measured"])

    found = session.stage(state.mapInArrow(distances, "vec_id long, cluster int, distance long, measured int"), "distances")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per cluster
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    facts = [(j, inertia.get(j, 0), total, digests[j]) for j in range(width)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(known), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")
