"""Near-duplicate vectors of equal label, by sorted projection passes.

A pass orders vectors lexicographically by concatenated random hashes (each the
number of the largest of 64 random projections, with its sign), compares every
vector with the `window` vectors after it, and keeps the verified pairs; the pairs
of all passes are united.  The number of passes follows from the wanted recall and
the number of vectors of a label.

Copies would fill the windows, so vectors are drawn together first.  Equal vectors
become one with a count.  Then vectors that share a label and three hashes are
measured against the first of them, its head; those within half the linking angle
form a ball, in which any two must link, and leave.  The passes compare heads.  Two
balls whose heads and radii leave no doubt link wholly or not at all; for the
others each member is measured against the other head, and only members in the
ring about the linking angle meet one by one.  So links inside and between groups
of copies are counted without making pairs of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from worklore import session
from worklore.llm.components import components

_HASHES, _WIDE = 8, 64  # 8 hashes of 7 bits
_AGREE = 0.53  # a hash's chance to be equal at cosine 0.93, see tests
_RING = 0.02  # radians
_UNSURE = 1e-6  # angles closer than this to a limit are decided by the cosine itself
_NODE = "struct<id:long,mark:long>"


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to norm 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _planes(size: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, size]).normal(size=(size, _HASHES * _WIDE))


def hash_keys(unit: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The concatenated hashes of a pass, the first one in the highest bits."""
    y = (unit @ _planes(unit.shape[1], number, seed)).reshape(-1, _HASHES, _WIDE)
    at = np.abs(y).argmax(2)
    up = np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] > 0
    return ((at * 2 + up).astype(np.int64) << (7 * np.arange(_HASHES - 1, -1, -1))).sum(1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        yield batch.take(pa.array(np.flatnonzero(lengths == size))) if (lengths != size).any() else batch


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows that can link: neither null, zero nor with null or non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null").where(~F.coalesce(bad, F.lit(True))).where(some)


def _keyed(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """Adds keys, the hash key of every pass."""

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in _by_length(batch, "embedding") if batch.num_rows else ():
                unit = _unit(part.column("embedding"))
                keys = np.stack([hash_keys(unit, p, seed) for p in range(passes)], 1)
                yield part.append_column("keys", pa.array(list(keys), pa.list_(pa.int64())))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, keys array<long>")


def _angles(rows: DataFrame, one: str, other: str, out: str) -> DataFrame:
    """Adds the angle (or, where out is "cosine", the cosine) of two vector columns and drops other; for the cosine one too."""

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in _by_length(batch, one) if batch.num_rows else ():
                cosine = (_unit(part.column(one)) * _unit(part.column(other))).sum(1)
                part = part.drop_columns([one, other]) if out == "cosine" else part.drop_columns([other])
                yield part.append_column(out, pa.array(cosine if out == "cosine" else _angle(cosine)))

    gone = {one, other} if out == "cosine" else {other}
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in gone)
    return rows.mapInArrow(run, f"{kinds}, {out} double")


def _balls(distinct: DataFrame, radius: float, rounds: int) -> DataFrame:
    """Adds head and angle to it: every vector is in one ball, most of them alone."""
    place = ["label", "size", "near"]
    active, done = distinct, []
    for r in range(rounds):
        near = active.withColumns({"size": F.size("embedding"), "near": F.shiftright(F.element_at("keys", r + 1), 7 * (_HASHES - 3))})
        heads = near.groupBy(*place).agg(F.min(F.struct("node", "embedding")).alias("h"), F.count("*").alias("n")).where("n > 1")
        heads = heads.select(*place, F.col("h.node").alias("head"), F.col("h.embedding").alias("middle"))
        met = near.join(heads, place).drop("size", "near")
        found = session.stage(_angles(met, "embedding", "middle", "angle").where(F.col("angle") <= radius), "balls")
        found = found.withColumn("angle", F.when(F.col("node") == F.col("head"), 0.0).otherwise(F.col("angle")))
        done.append(found)
        active = session.stage(active.join(found.select("node"), "node", "left_anti").select(active.columns), "active")
    out = active.withColumns({"head": F.col("node"), "angle": F.lit(0.0)})
    for found in done:
        out = out.unionByName(found)
    return out


def _windows(heads: DataFrame, number: int, window: int, block: int, limit: float) -> DataFrame:
    """(a, b, sure) of one pass: pairs within a window that link wholly (sure) or may link in part."""
    spark = heads.sparkSession
    order = ["label", "size", F.element_at("keys", number + 1), "node"]
    ordered = heads.repartitionByRange(*order).sortWithinPartitions(*order).drop("keys").withColumn("at", F.monotonically_increasing_id())
    ordered = session.stage(ordered, "ordered")
    part = F.shiftright("at", 33).alias("part")
    counts = sorted(tuple(r) for r in ordered.groupBy(part).count().collect())  # a row per partition
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, base long")
    placed = ordered.withColumn("part", part).join(F.broadcast(bases), "part")  # a row per partition
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    placed = placed.select("node", "label", "size", "embedding", "radius", place.alias("place"))
    own = F.floor(F.col("place") / block)
    blocks = F.when(F.col("place") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("place")
        place, size = rows.column("place").to_numpy(), rows.column("size").to_numpy()
        kind = np.unique(rows.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        radius = rows.column("radius").to_numpy()
        here = place >= key[0].as_py() * block
        ones, others, sure = [], [], []
        for width in np.unique(size).tolist():
            some = np.flatnonzero(size == width)
            unit = _unit(rows.column("embedding").take(pa.array(some)))
            for at in range(0, len(some), window):
                i, j = some[at : at + window], some[at : at + 2 * window]
                cosine = unit[at : at + window] @ unit[at : at + 2 * window].T
                gap = place[j][None, :] - place[i][:, None]
                reach = limit + radius[i][:, None] + radius[j][None, :]
                angle = _angle(cosine)
                fits = (gap > 0) & (gap <= window) & here[j][None, :] & (kind[i][:, None] == kind[j][None, :])
                x, y = np.nonzero(fits & (angle <= reach + _UNSURE))
                lone = reach[x, y] == limit
                linked = np.where(lone, cosine[x, y] >= math.cos(limit), angle[x, y] + (reach[x, y] - limit) <= limit - _UNSURE)
                keep = linked | ~lone
                ones.append(i[x[keep]])
                others.append(j[y[keep]])
                sure.append(linked[keep])
        none = np.zeros(0, np.int64)
        a, b = (rows.column("node").take(pa.array(np.concatenate([none, *p]))) for p in (ones, others))
        return pa.Table.from_arrays([a, b, pa.array(np.concatenate([np.zeros(0, bool), *sure]))], ["a", "b", "sure"])

    spread = placed.withColumn("block", F.explode(blocks))
    return spread.groupBy("block").applyInArrow(compare, f"a {_NODE}, b {_NODE}, sure boolean")


def _partial_links(members: DataFrame, heads: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """(node, head, other, n): rows of the ball `other` that a member of the ball `head` links with."""
    both = pairs.select(F.col("a").alias("head"), F.col("b").alias("other"))
    both = both.union(both.select("other", "head"))
    facing = heads.select(F.col("node").alias("other"), F.col("embedding").alias("middle"), "radius", "weight")
    met = members.select("node", "head", "embedding").join(both, "head").join(facing, "other")
    measured = session.stage(_angles(met, "embedding", "middle", "angle"), "facing")
    angle, radius = F.col("angle"), F.col("radius")
    whole = angle + radius <= limit - _UNSURE
    sure = measured.where(whole).select("node", "head", "other", F.col("weight").alias("n"))
    open_ = measured.where(~whole & (angle - radius <= limit + _UNSURE)).drop("radius", "weight")
    ring = F.floor(F.col("angle") / _RING).alias("ring")
    rings = members.groupBy(F.col("head").alias("other"), ring).agg(
        F.sum("copies").alias("weight"), F.max("angle").alias("outer"), F.min("angle").alias("inner")
    )
    wide = open_.join(rings, "other").where(angle - F.col("outer") <= limit + _UNSURE)
    within = angle + F.col("outer") <= limit - _UNSURE
    by_ring = wide.where(within).select("node", "head", "other", F.col("weight").alias("n"))
    mates = members.select(F.col("head").alias("other"), ring, F.col("embedding").alias("mate"), "copies", F.col("angle").alias("out"))
    close = wide.where(~within).select("node", "head", "other", "ring", "embedding", "angle").join(mates, ["other", "ring"])
    checked = _angles(close.where(angle - F.col("out") <= limit + _UNSURE), "embedding", "mate", "cosine")
    one_by_one = checked.where(F.col("cosine") >= math.cos(limit)).select("node", "head", "other", F.col("copies").alias("n"))
    return session.stage(sure.union(by_ring).union(one_by_one), "partial")


def similar_vectors(
    vectors: DataFrame, cosine: float = 0.93, window: int = 128, recall: float = 0.995, rounds: int = 3, seed: int = 29
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Rows link when their labels are equal and not null, their vectors have one
    length and their cosine is at least `cosine`; every link found is verified or
    follows from the triangle inequality.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without id or label, link with
    nothing and are kept.  Repeated rows link with one another; rows of one id with
    different vectors are told apart by the vector.  component_id is the smallest
    id reachable, null for a null id.

    recall: wanted share of pairs at just `cosine` whose vectors share a window in
    some pass; closer pairs are found more often.  A vector that has more than
    `window` other heads between itself and a partner in every pass misses it.
    """
    limit = math.acos(cosine)
    rows = session.stage(usable(vectors), "usable")
    distinct = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    node = F.struct(F.col("id"), F.xxhash64("embedding").alias("mark"))
    distinct = session.stage(distinct.select(node.alias("node"), "label", "embedding", "copies"), "distinct")
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    levels = max(1.0, math.log(max(1.0, most / window)) / math.log(2 * _WIDE))
    passes = max(rounds, math.ceil(math.log(1 - recall) / math.log(1 - _AGREE**levels)))
    members = session.stage(_balls(_keyed(distinct, passes, seed), limit / 2 - _UNSURE, rounds), "members")
    lead = F.first(F.when(F.col("node") == F.col("head"), F.struct("label", "embedding", "keys")), ignorenulls=True)
    heads = members.groupBy("head").agg(lead.alias("lead"), F.sum("copies").alias("weight"), F.max("angle").alias("radius"))
    heads = heads.select(F.col("head").alias("node"), "lead.*", "weight", "radius").withColumn("size", F.size("embedding"))
    heads = session.stage(heads, "heads")
    found = None
    for p in range(passes):
        pairs = session.stage(_windows(heads, p, window, 4 * window, limit), "pairs")
        found = pairs if found is None else found.union(pairs)
    pairs = session.stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct(), "pairs")
    sure = pairs.where("sure").select("a", "b")
    partial = _partial_links(members.drop("keys"), heads, pairs.where("not sure"), limit)
    edges = sure.union(partial.select(F.col("head").alias("a"), F.col("other").alias("b")))
    roots = components(edges).select(F.col("node").alias("head"), F.col("root.id").alias("root"))
    beside = sure.union(sure.select("b", "a")).join(heads.select(F.col("node").alias("b"), "weight"), "b")
    beside = beside.groupBy(F.col("a").alias("head")).agg(F.sum("weight").alias("beside"))
    balls = heads.select(F.col("node").alias("head"), "weight").join(beside, "head", "left").join(roots, "head", "left")
    apart = partial.groupBy("node").agg(F.sum("n").alias("apart"))
    facts = members.select("node", "head", "label", "embedding").join(balls, "head").join(apart, "node", "left")
    n_links = F.col("weight") - 1 + F.coalesce("beside", F.lit(0)) + F.coalesce("apart", F.lit(0))
    facts = facts.select("label", "embedding", n_links.alias("n_links"), F.coalesce("root", "head.id").alias("component_id"))
    facts = session.stage(facts, "facts")
    linked = rows.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    alone = vectors.where(~F.coalesce(can, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
