"""Clustering against plain whole-number arithmetic."""

import hashlib

import numpy as np
import pytest

from worklore.llm import centroids


def plain_clusters(vectors, k, rounds):
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in vectors if i is not None)
    centres = [list(q) for _, q in order[:k]]
    for r in range(rounds + 1):
        costs = [[sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres] for _, q in vectors]
        chosen = [min(range(len(centres)), key=lambda j: (row[j], j)) for row in costs]
        if r < rounds:
            for j in range(len(centres)):
                own = [q for (_, q), c in zip(vectors, chosen, strict=True) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    least = [row[c] for row, c in zip(costs, chosen, strict=True)]
    within = [sum(d for d, c in zip(least, chosen, strict=True) if c == j) for j in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, within[c], sum(least), digests[c]) for (i, _), c, d in zip(vectors, chosen, least, strict=True)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, q int"


@pytest.mark.parametrize("k,rounds,spread", [(5, 4, 1.0), (16, 3, 0.05), (3, 6, 30000.0)])
def test_clusters_are_those_of_measuring_everything(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * spread + rng.normal(size=8) * 0.1).tolist(), "x", 1) for i in range(400)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None), (500, None, "x", 1), (501, [1.0] * 7, "x", 1)]
    rows += [(502, [float("nan")] + [0.0] * 7, "x", 1), (503, [None] + [0.0] * 7, "x", 1), (504, [float("inf")] * 8, "x", 1)]
    rows += [(600 + i, [0.0] * 8, "tie", 1) for i in range(4)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, 8)
    kept = [(r[0], np.floor(64 * np.array(r[1])).astype(int).tolist()) for r in rows if r[0] not in range(500, 505)]
    found = got.collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, plain_clusters(kept, k, rounds)))
    if spread == 1.0:
        assert sum(r.measured for r in found) < k * len(found) / 2  # bounds spare most distances


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_vectors(empty, size=8).count() == 0
    two = spark.createDataFrame([(1, [0.5, 0.0], "", 0), (2, [0.5, 0.0], "", 0)], SCHEMA)
    rows = centroids.cluster_vectors(two, size=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in rows] == [(0, 0, 0)] * 2


def test_components_beyond_whole_distances_fail(spark):
    huge = spark.createDataFrame([(1, [1e300, 0.0], "", 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(huge, size=2)
