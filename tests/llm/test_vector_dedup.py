"""Near-duplicate vectors against all pairs."""

import numpy as np

from worklore.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<double>, label string, node string, keys int"


def plain(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(r):
        x = np.array([np.nan if y is None else y for y in r[1] or []], float)
        ok = r[0] is not None and r[2] is not None and len(x) and np.isfinite(x).all() and x.any()
        return x / np.linalg.norm(x) if ok else None

    units = [unit(r) for r in rows]
    groups = {}
    for i, u in enumerate(units):
        if u is not None:
            groups.setdefault((rows[i][2], len(u)), []).append(i)
    for members in groups.values():
        near = np.stack([units[i] for i in members])
        for x, y in np.argwhere(np.triu(near @ near.T >= cosine, 1)):
            a, b = members[x], members[y]
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    ids = [None if r[0] is None else least[find(i)] for i, r in enumerate(rows)]
    return sorted(map(repr, ((r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, ids, strict=True))))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = vector_dedup.similar_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(repr, map(tuple, out.collect())))


def around(rng, centre, spread, n):
    x = centre + spread * rng.normal(size=(n, len(centre))) / np.sqrt(len(centre))
    return x.tolist()


def test_groups_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 24)).tolist()
    for spread, n in ((0.5, 60), (0.8, 25), (1.0, 20), (1.2, 30), (0.2, 400), (1.9, 12)):
        centre = rng.normal(size=24)
        vectors += around(rng, centre * 5 / np.linalg.norm(centre), spread, n)
    rows = [(int(i), v, "ba"[min(int(i) % 7, 1)], "x", 1) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    exact = rows[400]
    rows += [(9000 + i, exact[1], exact[2], None, None) for i in range(50)]
    rows += [exact, (exact[0], rows[0][1], exact[2], "", 0), (9100, (np.array(exact[1]) * 1e150).tolist(), exact[2], "", 0)]
    rows += [(None, exact[1], exact[2], "", 0), (9201, exact[1], None, "", 0), (9202, None, "a", "", 0), (9203, [], "a", "", 0)]
    rows += [(9204, [0.0] * 24, "a", "", 0), (9205, [None, *exact[1][1:]], "a", "", 0), (9206, [float("nan")] * 24, "a", "", 0)]
    rows += [(9207, [1.0, 0.0], "a", "", 0), (9208, [2.0, 0.1], "a", "", 0), (9209, [1.0, 0.0], "b", "", 0), (9210, [-0.0, 0.0], "a", "", 0)]
    assert found(spark, rows, window=64) == plain(rows)


def test_windows_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 32))
    vectors = np.concatenate([c + 0.16 * rng.normal(size=(5, 32)) for c in centres]).tolist()
    rows = [(i, v, "one", "", 0) for i, v in enumerate(vectors)]
    got, want = found(spark, rows, window=16, recall=0.9999), plain(rows)
    assert len(set(got) & set(want)) > 0.97 * len(want)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_hashes_agree_as_often_as_counted_on():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    first = [vector_dedup.hash_keys(x, 0, 1) >> 49 for x in (a, c)]
    assert (first[0] == first[1]).mean() > vector_dedup._AGREE - 0.02


def test_given_vectors(spark):
    from worklore.llm import queries

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = queries.op11_near_vectors(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows)
