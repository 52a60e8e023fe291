"""Similarity self-join on word n-grams: a prefix join over groups of documents.

A document is the set of its distinct n-grams of words; two documents link when
100 * |A and B| >= percent * |A or B|.

1. Sets equal in all n-grams are one class, so copies count once from here on.
2. N-grams are ordered by how many documents hold them, rarest first.  Linked
   sets share an n-gram among the first |A| - ceil(percent * |A| / 100) + 1 of
   each, their prefixes.  N-grams of one document can't be shared, so a prefix
   keeps only the places and names of its shared ones.
3. Classes of equal size and equal prefix form a group.  Groups that share a
   prefix n-gram pair up when their sizes and the places of that n-gram still
   allow enough overlap.
4. Pairs are expanded to members and verified on whole sets.

Which documents are connected is found by pairs in two steps.  First, the members
of every group meet one hub of each of its prefix n-grams (the first member of the
group with the fewest rarer n-grams) and the first member of their own group.  Then
all remaining pairs meet whose members are not yet connected.  A family of many near
copies is thus joined by a number of pairs in proportion to its size.

All links lie inside these components, so links are counted there: a component is
complete when its verified links are all its pairs; the classes of any other are
dealt into blocks, and every two blocks meet once, as matrices of shared n-grams.
The comparisons grow with the square of a component, but no row is made for a pair
and a task holds two blocks.

Counting crosses the network as packed arrays: a batch of documents sends each
slice of the n-gram space one array of 48-bit names.  A name stands for an n-gram
only in finding pairs; sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from worklore import session
from worklore.llm import textscan
from worklore.llm.components import components
from worklore.llm.joins import sized

_SLICED = "slice long, batch long, names binary, refs binary, counts binary, ids binary, sizes binary, digests binary"
_PLACED = "id long, n_shingles long, digest binary, places array<int>, names array<long>"
_NO_ID = (1 << 63) - 1
_NODE = "struct<id:long,digest:binary>"


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word n-grams of every text, sorted.

    Words are runs of non-white bytes, A-Z lower-cased; a text of fewer than n
    words has its whole sequence as the only n-gram, one without words has none.
    """
    w = textscan.words(texts, lower=True)
    h = w.hashes()
    counts = np.bincount(w.doc, minlength=w.n_docs)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    docs, grams = [], []
    for size in range(1, n + 1):
        run = textscan.runs(h, size) ^ np.uint64(size)
        if size < n:
            own = np.flatnonzero(counts == size)
            docs.append(own)
            grams.append(run[firsts[own]])
        else:
            inside = np.flatnonzero(w.doc[: len(run)] == w.doc[len(h) - len(run) :])
            docs.append(w.doc[inside])
            grams.append(run[inside])
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    by = np.lexsort((gram, doc))
    doc, gram = doc[by], gram[by]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[fresh], gram[fresh]


def digests(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[bytes]]:
    """Size of every text's set, and 16 bytes that are equal for equal sets."""
    sizes = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(sizes)
    halves = []
    for salt in (0x9AE16A3B2F90404F, 0xC949C7DEFEB1B35B):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan._mixed(gram + np.uint64(salt)))])
        halves.append(sums[ends] - sums[ends - sizes])
    raw = np.stack(halves, 1).tobytes()
    return sizes, [raw[16 * i : 16 * i + 16] for i in range(n_docs)]


def _prefixes(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: id, size, digest, and the shared n-grams within its prefix."""
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(64, total >> 23)

    def sliced(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 32
        for batch in textscan.batches(arriving, "text"):
            doc, gram = shingles(batch.column("text"), n)
            sizes, digest = digests(doc, gram, batch.num_rows)
            by = np.argsort(gram)
            name, ref = gram[by] >> np.uint64(16), doc[by].astype("<u2")
            cuts = np.searchsorted((name * np.uint64(slices)) >> np.uint64(48), np.arange(slices + 1))
            used = np.flatnonzero(np.diff(cuts))
            raw = np.zeros((len(name), 3), "<u2")
            for i in range(3):
                raw[:, i] = (name >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            names = [raw[a:b].tobytes() for a, b in zip(cuts[used], cuts[used + 1], strict=True)]
            refs = [ref[a:b].tobytes() for a, b in zip(cuts[used], cuts[used + 1], strict=True)]
            rest, ids = [None] * len(used), batch.column("id").to_numpy(zero_copy_only=False).astype("<i8")
            columns = [
                pa.array([*used.tolist(), slices + count % slices], pa.int64()),
                pa.array([count] * (len(used) + 1), pa.int64()),
                pa.array([*names, None], pa.binary()),
                pa.array([*refs, None], pa.binary()),
                pa.array([*rest, None], pa.binary()),
                pa.array([*rest, ids.tobytes()], pa.binary()),
                pa.array([*rest, sizes.astype("<i8").tobytes()], pa.binary()),
                pa.array([*rest, b"".join(digest)], pa.binary()),
            ]
            count += 1
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SLICED.split(", ")])

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        """Of one slice: the names that two documents hold, with their counts, by batch."""
        if key[0].as_py() >= slices:
            return rows
        names, refs = rows.column("names").to_pylist(), rows.column("refs").to_pylist()
        sizes = [len(r) // 2 for r in refs]
        name = _names(b"".join(names))
        by = np.argsort(name)
        ordered = name[by]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(edge, len(ordered)))
        count = np.zeros(len(name), np.int64)
        count[by] = np.repeat(times, times)
        shared = count > 1
        raw, ref = np.frombuffer(b"".join(names), "<u2").reshape(-1, 3), np.frombuffer(b"".join(refs), "<u2")
        out, at = [], 0
        for size in sizes:
            own = np.flatnonzero(shared[at : at + size]) + at
            out.append((raw[own].tobytes(), ref[own].tobytes(), count[own].astype("<i4" if count.max() < 1 << 31 else "<i8").astype("<i8").tobytes()))
            at += size
        for i, column in enumerate(("names", "refs", "counts")):
            place = rows.column_names.index(column)
            rows = rows.set_column(place, column, pa.array([o[i] for o in out], pa.binary()))
        return rows.filter(pa.array([bool(o[1]) for o in out]))

    def placed(key: tuple, rows: pa.Table) -> pa.Table:
        """Of one batch: every document's prefix."""
        kept = {c: [x for x in rows.column(c).to_pylist() if x is not None] for c in ("names", "refs", "counts", "ids", "sizes", "digests")}
        ids, sizes = np.frombuffer(kept["ids"][0], "<i8"), np.frombuffer(kept["sizes"][0], "<i8")
        name, ref = _names(b"".join(kept["names"])), np.frombuffer(b"".join(kept["refs"]), "<u2").astype(np.int64)
        count = np.frombuffer(b"".join(kept["counts"]), "<i8")
        by = np.lexsort((name, count, ref))
        name, ref = name[by], ref[by]
        many = np.bincount(ref, minlength=len(ids))
        starts = np.cumsum(many) - many
        place = np.arange(len(ref)) - starts[ref] + (sizes - many)[ref]
        within = place < (sizes - -(-percent * sizes // 100) + 1)[ref]
        name, ref, place = name[within], ref[within], place[within]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(ref, minlength=len(ids)))]), pa.int32())
        raw = kept["digests"][0]
        columns = [
            pa.array(ids),
            pa.array(sizes),
            pa.array([raw[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(name.astype(np.int64))),
        ]
        return pa.Table.from_arrays(columns, ["id", "n_shingles", "digest", "places", "names"])

    blobs = documents.mapInArrow(sliced, _SLICED).groupBy("slice").applyInArrow(counted, _SLICED)
    return session.stage(blobs.groupBy("batch").applyInArrow(placed, _PLACED), "prefixes")


def _names(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, "<u2").reshape(-1, 3).astype(np.uint64)
    return parts[:, 0] | parts[:, 1] << np.uint64(16) | parts[:, 2] << np.uint64(32)


def _sets(documents: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the nodes' documents: the hashes of a set, ascending."""

    def sets(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.batches(arriving, "text"):
            doc, gram = shingles(batch.column("text"), n)
            sizes, digest = digests(doc, gram, batch.num_rows)
            ends = np.cumsum(sizes)
            raw = [gram[e - s : e].astype("<u8").tobytes() for e, s in zip(ends, sizes, strict=True)]
            columns = [batch.column("id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "grams"])

    ids = nodes.select("node.id").distinct()
    held = documents.join(sized(ids), "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, digest binary, grams binary")
    return held.dropDuplicates(["id", "digest"]).select(F.struct("id", "digest").alias("node"), "grams")


def _linked(documents: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes (id, digest): those whose sets are similar enough."""
    pairs = session.stage(pairs, "pairs")
    held = _sets(documents, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), n)

    def compared(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            good = []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    whole = pairs.join(held.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    whole = whole.join(held.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    return session.stage(whole.select("a", "b", "grams_a", "grams_b").mapInArrow(compared, f"a {_NODE}, b {_NODE}"), "linked")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets numbered a share with those numbered b, a few thousand elements at a time."""
    ends = np.cumsum([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[name] > 1
    member, name = member[shared], rank[name[shared]]
    by = np.argsort(name, kind="stable")
    member, name = member[by], name[by]
    out, width = np.zeros((len(a), len(b)), np.int64), 4096
    for low in range(0, int(rank[-1]) + 1 if len(ends) else 0, width):
        at, to = np.searchsorted(name, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[member[at:to], name[at:to] - low] = 1
        out += np.rint(held[a] @ held[b].T).astype(np.int64)
    return out


def _links(documents: DataFrame, classes: DataFrame, links: DataFrame, roots: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(node, others): the rows outside a class that its rows link with, for every class of a component."""
    rooted = session.stage(roots.join(classes.select("node", "n_shingles", "copies"), "node"), "rooted")
    found = links.select(F.col("a").alias("node")).join(roots, "node").groupBy("root").agg(F.count("*").alias("found"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("k"), F.sum("copies").alias("rows"), F.sum("n_shingles").alias("weight")).join(found, "root")
    blocks = F.ceil(F.greatest(F.col("k") / block, F.col("weight") / (4096 * block)))
    sizes = sizes.select("root", "rows", "weight", (2 * F.col("found") == F.col("k") * (F.col("k") - 1)).alias("whole"), blocks.alias("blocks"))
    rooted = session.stage(rooted.join(sizes, "root"), "families")
    whole = rooted.where("whole").select("node", (F.col("rows") - F.col("copies")).alias("others"))
    part = rooted.where("not whole")
    cells = 1 + (part.where("blocks = 1").agg(F.sum("n_shingles")).first()[0] or 0) // (1024 * block)
    family, own = F.xxhash64("root"), F.pmod(F.xxhash64("node"), "blocks")
    dealt = part.join(_sets(documents, part, n), "node").select("node", "copies", "grams", "blocks", family.alias("family"), own.alias("own"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cell = F.when(F.col("blocks") == 1, F.pmod("family", F.lit(cells))).otherwise(F.xxhash64("family", low, high))
    dealt = dealt.select(cell.alias("cell"), "family", low.alias("low"), high.alias("high"), "own", "node.id", "node.digest", "copies", "grams")

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        family, low, high, own, copies = (rows.column(c).to_numpy() for c in ("family", "low", "high", "own", "copies"))
        sets = [np.frombuffer(x, "<u8") for x in rows.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets])
        others = np.zeros(len(sets), np.int64)
        by = np.lexsort((high, low, family))
        new = np.any(np.stack([x[by][1:] != x[by][:-1] for x in (family, low, high)]), 0)
        for among in np.split(by, np.flatnonzero(new) + 1):
            first, second = (np.flatnonzero(own[among] == x[among]) for x in (low, high))
            common = _common([sets[i] for i in among], first, second)
            a, b = among[first], among[second]
            good = (100 + percent) * common >= percent * (size[a][:, None] + size[b][None, :])
            good &= a[:, None] != b[None, :]
            others[a] += good @ copies[b]
            if low[among[0]] != high[among[0]]:
                others[b] += copies[a] @ good
        return pa.Table.from_arrays([rows.column("id"), rows.column("digest"), pa.array(others)], ["id", "digest", "others"])

    counts = dealt.groupBy("cell").applyInArrow(counted, "id long, digest binary, others long")
    counts = counts.groupBy(F.struct("id", "digest").alias("node")).agg(F.sum("others").alias("others"))
    return whole.union(counts)


def _families(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, n_shingles, digest), classes (node, n_shingles, copies), and of classes verified links and roots.

    The links connect all that is connected; inside a component there may be more.
    """
    rows = _prefixes(documents, n, percent)
    classes = rows.where("n_shingles > 0").groupBy("digest", "n_shingles", "places", "names").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = session.stage(classes.select(F.struct("id", "digest").alias("node"), "n_shingles", "copies", "places", "names"), "classes")

    near = classes.where(F.size("names") > 0)
    groups = near.groupBy("n_shingles", "places", "names").agg(F.min("node").alias("lead"), F.count("*").alias("members"))
    members = session.stage(
        near.join(groups, ["n_shingles", "places", "names"]).select("lead", "node"), "members"
    )
    # The members of one group share its first name too, which no other group may hold.
    several, first = F.col("members") > 1, F.get("places", F.lit(0))
    entries = groups.select("lead", "n_shingles", several, first, F.inline(F.arrays_zip("places", "names")))
    entries = entries.toDF("lead", "size", "several", "first", "place", "name")
    own = F.col("several") & (F.col("place") == F.col("first"))
    held = entries.groupBy("name").agg(F.count("*").alias("held"), F.min(F.struct("place", "size", "lead")).alias("hub"))
    entries = session.stage(entries.join(held, "name").where((F.col("held") > 1) | own).drop("held", "several", "first"), "entries")

    def may_link(size_a: str, place_a: str, size_b: str, place_b: str):
        sa, pa_, sb, pb = (F.col(c).cast("long") for c in (size_a, place_a, size_b, place_b))
        fit = (100 * sa >= percent * sb) & (100 * sb >= percent * sa)
        return fit & ((100 + percent) * F.least(sa - pa_, sb - pb) >= percent * (sa + sb))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()

    met = entries.where(may_link("size", "place", "hub.size", "hub.place")).select("lead", F.col("hub.lead").alias("b")).distinct()
    stars = met.join(members, "lead").select(F.col("node").alias("a"), "b")
    stars = stars.union(members.select(F.col("lead").alias("a"), F.col("node").alias("b")))
    links = _linked(documents, ordered(stars), n, percent)
    roots = components(links)

    rooted = members.join(roots, "node", "left").select("lead", "node", F.coalesce("root", "node").alias("root"))
    rooted = session.stage(rooted, "rooted")
    shares = entries.drop("hub").join(rooted.select("lead", "root").distinct(), "lead")
    mixed = shares.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    shares = session.stage(shares.join(mixed.select("name"), "name", "left_semi"), "shares")
    a = shares.select("name", *(F.col(c).alias(f"{c}_a") for c in ("lead", "size", "place", "root")))
    b = shares.select("name", *(F.col(c).alias(f"{c}_b") for c in ("lead", "size", "place", "root")))
    rest = a.join(b, (a["name"] == b["name"]) & (a["root_a"] < b["root_b"]) & may_link("size_a", "place_a", "size_b", "place_b"))
    rest = rest.select("lead_a", "root_a", "lead_b", "root_b").distinct()
    rest = rest.join(rooted.toDF("lead_a", "a", "root_a"), ["lead_a", "root_a"]).join(rooted.toDF("lead_b", "b", "root_b"), ["lead_b", "root_b"])
    links = links.union(_linked(documents, ordered(rest.select("a", "b")), n, percent))
    return rows.select("id", "n_shingles", "digest"), classes.select("node", "n_shingles", "copies"), links, components(links)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and n_links of its class."""
    labels = classes.join(roots, "node", "left").select(
        F.col("node.digest").alias("digest"), F.coalesce("root.id", "node.id").alias("component_id"), "n_links"
    )
    id_or_null = lambda c: F.nullif(c, F.lit(_NO_ID))
    return rows.join(labels, "digest", "left").select(
        id_or_null(F.col("id")).alias("doc_id"),
        "n_shingles",
        id_or_null(F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def similar_documents(documents: DataFrame, n: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row.

    component_id is the smallest doc_id that links reach, the row's own included;
    n_links counts the other rows that the row links with, copies included.
    A row without words has no set and links with nothing; rows with a null
    doc_id take part and have a null component_id unless a link gives them one.
    Repeated rows are copies of one another.  Further columns are ignored.
    block: classes of a component that are counted at once on either side.
    """
    documents = _keyed(documents)
    rows, classes, links, roots = _families(documents, n, percent)
    others = _links(documents, classes, links, roots, n, percent, block)
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    return _labelled(rows, classes.join(others, "node", "left").select("node", n_links.alias("n_links")), roots)


def keep_one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its component; null ids stay."""
    rows, classes, _, roots = _families(_keyed(documents), n, percent)
    found = _labelled(rows, classes.withColumn("n_links", F.lit(0)), roots).where("doc_id != component_id").select("doc_id").distinct()
    return documents.join(sized(session.stage(found, "copies")), "doc_id", "left_anti").select(documents.columns)
