"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

Tokens A are those of a byte-level BPE file, tokens B those of a sentencepiece BPE
model, over one string (a space and the text).  Places where tokens of both end cut
the string into groups; within a group every A token is linked with every B token.

First pass: every task sums, for the id pairs of its documents, in how many of them
a pair is linked.  The distinct pairs, merged in a tree, get a minimal perfect hash;
the sums are laid out as dense vectors indexed by that hash and added in a tree.
Second pass: documents are aligned again and look their pairs up, the built keys
being compared.  The lookup table is sent to tasks in parts of at most `most_pairs`
pairs, with one pass over the documents for each part.

Between a character that is no white space and a space tokens of both end and none
depends on what lies beyond, so texts are cut there, and each worker keeps what
it found for a piece.  A pair is one 32-bit number; there are no more pairs than the
vocabularies' product, so a segment of the hash (one of 256) is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from worklore import session
from worklore.llm.bpe import byte_letters
from worklore.llm.minimal_hash import SEGMENTS, Lookup, build, segment_of
from worklore.llm.textscan import batches, span_hashes, take_spans, text_bytes
from worklore.llm.wordcodes import Encoder, WordTable

_FAN = 32
_RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Ragged:
    """Rows of different lengths, one after another."""

    def __init__(self, kind: type) -> None:
        self.flat, self.offsets, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        base, more = int(self.offsets[self.n]), len(lengths)
        for name, need in (("flat", base + len(values)), ("offsets", self.n + more + 1)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        self.flat[base : base + len(values)] = values
        self.offsets[self.n + 1 : self.n + 1 + more] = base + np.cumsum(lengths)
        self.n += more

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return take_spans(self.flat, self.offsets, which)


def _entries(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries one after another, and where each starts (one more than entries)."""
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their values."""
    if not len(keys):
        return keys, values
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[by], first)


class Aligner:
    """Aligns texts by two files; one of these lives in each worker.

    byte_file: byte-level BPE for the tokenizers library (up to 65,536 ids).
    piece_file: sentencepiece model of which no piece has a space after another
    character (checked).
    """

    def __init__(self, byte_file: str, piece_file: str, most_pieces: int = 600_000) -> None:
        import sentencepiece

        self.a = Encoder(byte_file, most_pieces // 2)
        self.a.library.encode_special_tokens = True
        self.a.special = re.compile(r"(?!)")  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        values = {c: i for i, c in enumerate(byte_letters())}
        size = self.a.library.get_vocab_size()
        if size > 1 << 16 or self.b.get_piece_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # a special token's written form is no byte spelling, and its id never comes up
        a_bytes = [bytes(values.get(c, 0) for c in self.a.library.id_to_token(i) or "") for i in range(size)]
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece with a space after another character")
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_of = _entries(a_bytes), _entries(b_bytes)
        self.digits = _entries([b"%d;" % i for i in range(1 << 16)])
        self.space = self.b.piece_to_id("▁")
        self.most = most_pieces
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable(self.most)
        self.pairs, self.times, self.text = _Ragged(np.uint32), _Ragged(np.int64), _Ragged(np.uint8)
        self.counts = np.zeros((1 << 12, 5), np.int64)  # tokens A, tokens B, groups, links, whether bytes agree

    def _tokens(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number per piece, by A and by B."""
        ids, offsets = self.a.encode(pieces)
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)  # it puts a space before
        b = [[self.space] if p == " " else x for p, x in zip(pieces, b, strict=True)]
        flat = np.fromiter((i for x in b for i in x), np.int64)
        return [(ids.astype(np.int64), np.diff(offsets)), (flat, np.array([len(x) for x in b], np.int64))]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Align pieces that were not met before."""
        data, bounds = _entries([p.encode() for p in pieces])
        n, want = len(pieces), np.diff(bounds)
        sides, good = [], np.ones(n, bool)
        for (ids, number), (flat, starts) in zip(self._tokens(pieces), self.bytes_of, strict=True):
            raw, sizes = take_spans(flat, starts, ids)
            owner = np.repeat(np.arange(n), number)
            total = np.bincount(owner, sizes, n).astype(np.int64)
            same = total == want
            if len(raw) == len(data) and same.all():
                wrong = raw != data
                if wrong.any():
                    same[np.searchsorted(bounds, np.flatnonzero(wrong), "right") - 1] = False
            else:
                keep = np.repeat(same, want)
                wrong = raw[np.repeat(np.repeat(same, number), sizes)] != data[keep]
                same[np.searchsorted(bounds, np.flatnonzero(keep)[wrong], "right") - 1] = False
            good &= same
            sides.append((ids, number, owner, sizes))
        counts = np.zeros((n, 5), np.int64)
        counts[:, 4] = good
        tokens, ends = [], []
        for side, (ids, _, owner, sizes) in enumerate(sides):
            fine = good[owner]
            ids, owner, sizes = ids[fine], owner[fine], sizes[fine]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(owner, owner)  # the piece's first token
            ends.append(bounds[owner] + before - before[first] + sizes)
            tokens.append((ids, owner))
            counts[:, side] = np.bincount(owner, minlength=n)
        shared = np.intersect1d(*ends)
        groups = [np.searchsorted(shared, e) for e in ends]
        home = np.searchsorted(bounds, shared, "left") - 1  # the piece of each group
        counts[:, 2] = np.bincount(home, minlength=n)
        self._link(n, counts, shared, home, tokens, groups)
        self._spell(n, home, tokens, groups)
        if self.table.n + n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((max(n, len(self.counts)), 5), np.int64)])
        self.counts[self.table.n : self.table.n + n] = counts
        self.table.add(hashes, np.zeros(0, np.int32), np.zeros(n, np.int64))

    def _link(self, n: int, counts: np.ndarray, shared: np.ndarray, home: np.ndarray, tokens: list, groups: list) -> None:
        sets = [np.unique(g << 16 | ids, return_counts=True) for g, (ids, _) in zip(groups, tokens, strict=True)]
        first_b = np.searchsorted(sets[1][0] >> 16, np.arange(len(shared) + 1))
        of_a = sets[0][0] >> 16
        beside = (first_b[1:] - first_b[:-1])[of_a]
        b_at = np.repeat(first_b[of_a] - (np.cumsum(beside) - beside), beside) + np.arange(beside.sum())
        a_key, a_times = np.repeat(sets[0][0], beside), np.repeat(sets[0][1], beside)
        owner = home[a_key >> 16]
        times = a_times * sets[1][1][b_at]
        counts[:, 3] = np.bincount(owner, times, n).astype(np.int64)
        pair = owner << 32 | (a_key & 0xFFFF) << 16 | (sets[1][0][b_at] & 0xFFFF)
        pair, times = _summed(pair, times)
        lengths = np.bincount(pair >> 32, minlength=n)
        self.pairs.add((pair & 0xFFFFFFFF).astype(np.uint32), lengths)
        self.times.add(times, lengths)

    def _spell(self, n: int, home: np.ndarray, tokens: list, groups: list) -> None:
        """a1,a2|b1;  for every group, in order."""
        ids, group = np.concatenate([tokens[0][0], tokens[1][0]]), np.concatenate(groups)
        side = np.repeat([0, 1], [len(groups[0]), len(groups[1])])
        by = np.lexsort((side, group))  # stable, so tokens stay in order
        ids, group, side = ids[by], group[by], side[by]
        raw, sizes = take_spans(*self.digits, ids)
        follows = np.concatenate([(group[1:] == group[:-1]) & (side[1:] == side[:-1]), [False]])[: len(ids)]
        mark = np.where(follows, ord(","), np.where(side == 0, ord("|"), ord(";"))).astype(np.uint8)
        raw = raw.copy()
        raw[np.cumsum(sizes) - 1] = mark
        self.text.add(raw, np.bincount(home[group], sizes, n).astype(np.int64))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a space and each text, piece starts and ends, and each text's first piece; empty texts have none."""
        data, bounds = text_bytes(texts)
        n, lengths = len(bounds) - 1, np.diff(bounds)
        filled = np.flatnonzero(lengths > 0)
        out = np.full(len(data) + len(filled), 32, np.uint8)
        first = bounds[filled] + np.arange(len(filled))  # where the added spaces are
        body = np.ones(len(out), bool)
        body[first] = False
        out[body] = data
        cut = np.zeros(len(out), bool)
        before, at = out[:-1], np.flatnonzero(out[1:] == 32) + 1
        last = before[at - 1]
        plain = (last > 32) & (last < 127)
        wide = np.flatnonzero(last >= 128)
        two, three = out[np.maximum(at[wide] - 2, 0)], out[np.maximum(at[wide] - 3, 0)]
        space = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        plain[wide[~space]] = True  # any character that may be white space stays inside
        cut[at[plain]] = True
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(out)) if len(starts) else starts
        opened = np.zeros(n + 1, np.int64)
        opened[filled + 1] = np.diff(np.append(np.searchsorted(starts, first), len(starts)))
        return out, starts, ends, np.cumsum(opened)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kept row of each piece, after aligning new ones."""
        if self.table.n > self.most:
            self._clear()
        hashes = span_hashes(data, starts, ends)
        rows = self.table.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            for at in range(0, len(new), 20_000):
                some = missing[first[at : at + 20_000]].tolist()
                self._learn(new[at : at + 20_000], [data[starts[i] : ends[i]].tobytes().decode() for i in some])
            rows[missing] = self.table.find(hashes[missing])
        return rows

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], bytes]]:
        """(counts per text, text number and pair and times of every distinct pair of a text, spelling of a text).

        counts: tokens A, tokens B, groups, links; zeros where bytes differ.
        """
        data, starts, ends, first = self.pieces(texts)
        rows = self.rows(data, starts, ends)
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        held = self.counts[rows]
        fine = np.bincount(doc, 1 - held[:, 4], n) == 0
        counts = np.stack([np.bincount(doc, held[:, c], n) for c in range(4)], 1).astype(np.int64) * fine[:, None]
        used = fine[doc]
        keys, lengths = self.pairs.take(rows[used])
        times, _ = self.times.take(rows[used])
        pair, times = _summed(np.repeat(doc[used], lengths) << 32 | keys.astype(np.int64), times)

        def spelled(i: int) -> bytes:
            return self.text.take(rows[first[i] : first[i + 1]])[0][:-1].tobytes() if fine[i] else b""

        return counts, pair >> 32, (pair & 0xFFFFFFFF).astype(np.uint32), times, spelled


_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    """This worker's aligner of two files."""
    if (byte_file, piece_file) not in _KEPT:
        _KEPT[byte_file, piece_file] = Aligner(byte_file, piece_file)
    return _KEPT[byte_file, piece_file]


_PARTIAL = "segment int, block long, keys binary, sums binary"
_INDEX = "segment int, sizes array<int>, bits binary, keys binary"


def _partial_sums(documents: DataFrame, column: str, byte_file: str, piece_file: str) -> DataFrame:
    """(segment, block, keys, sums): per task, in how many of its documents a pair is linked."""

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def rows(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            segment = segment_of(keys)
            by = np.argsort(segment, kind="stable")
            at = np.searchsorted(segment[by], np.arange(SEGMENTS + 1))
            some = np.flatnonzero(np.diff(at))
            part = [by[at[s] : at[s + 1]] for s in some.tolist()]
            columns = [
                pa.array(some, pa.int32()),
                pa.array(np.full(len(some), block), pa.int64()),
                pa.array([keys[p].tobytes() for p in part], pa.binary()),
                pa.array([sums[p].tobytes() for p in part], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["segment", "block", "keys", "sums"])

        for batch in batches(arriving, column, 1 << 20):
            _, _, keys, _, _ = aligner(byte_file, piece_file).align(batch.column(column))
            held.append(_summed(keys, np.ones(len(keys), np.int64)))
            if sum(len(k) for k, _ in held) > 1 << 21:
                held = [merged()]
                if len(held[0][0]) > 1 << 20:
                    yield rows(*held[0])
                    held = []
        if held:
            yield rows(*merged())

    return documents.select(column).mapInArrow(run, _PARTIAL)


def _unpacked(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def _tree(df: DataFrame, blocks: int, schema: str, merge: Callable[[pa.Table], list], name: str) -> DataFrame:
    """Merge the blocks of each segment, a bounded number at a time, until one is left."""
    names = [part.split()[0] for part in schema.split(", ")]

    def step(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array([x], kind) for x, kind in merge(table)], names[2:]).add_column(
            0, names[1], pa.array([key[1].as_py()], pa.int64())
        ).add_column(0, names[0], pa.array([key[0].as_py()], pa.int32()))

    while True:
        df = df.withColumn("block", F.floor(F.col("block") / _FAN))
        df = session.stage(df.groupBy("segment", "block").applyInArrow(step, schema), name)
        blocks = -(-blocks // _FAN)
        if blocks <= 1:
            return df


def _built(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        made = [build(np.frombuffer(x, np.uint32)) for x in batch.column("keys").to_pylist()]
        columns = [
            batch.column("segment"),
            pa.array([m[0] for m in made], pa.list_(pa.int32())),
            pa.array([np.packbits(m[1]).tobytes() for m in made], pa.binary()),
            pa.array([m[2].tobytes() for m in made], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "sizes", "bits", "keys"])


def _lookup(table: pa.Table) -> Lookup:
    parts = []
    for r in table.select(["segment", "sizes", "bits", "keys"]).to_pylist():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sum(r["sizes"])).astype(bool)
        parts.append((r["segment"], r["sizes"], bits, np.frombuffer(r["keys"], np.uint32)))
    return Lookup.of(parts)


def pair_counts(documents: DataFrame, byte_file: str, piece_file: str, column: str = "text") -> DataFrame:
    """(segment, sizes, bits, keys, counts): the hash of all linked pairs, with their counts by number.

    A count is the number of rows of documents in which the pair is linked.
    """
    partial = session.stage(_partial_sums(documents, column, byte_file, piece_file), "pair-sums")
    blocks = (partial.agg(F.max("block")).first()[0] or 0) + 1

    def union(table: pa.Table) -> list:
        return [(np.unique(np.concatenate(_unpacked(table, "keys", np.uint32))).tobytes(), pa.binary())]

    distinct = _tree(partial.drop("sums"), blocks, "segment int, block long, keys binary", union, "pair-keys")
    index = session.stage(distinct.mapInArrow(_built, _INDEX), "pair-index")
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // _FAN).cast("long"))).alias("block")
    each = index.select("*", groups)

    def dense(key: tuple, sums: pa.Table, hashed: pa.Table) -> pa.Table:
        out: list = []
        if sums.num_rows:
            lookup = _lookup(hashed)
            vector = np.zeros(len(lookup.keys), np.int64)
            for keys, values in zip(_unpacked(sums, "keys", np.uint32), _unpacked(sums, "sums", np.int64), strict=True):
                vector[lookup.find(keys)] += values  # the keys of a row are distinct
            out.append(vector.tobytes())
        n = len(out)
        columns = [pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(out, pa.binary())]
        return pa.Table.from_arrays(columns, ["segment", "block", "counts"])

    grouped = partial.withColumn("block", F.floor(F.col("block") / _FAN))
    vectors = grouped.groupBy("segment", "block").cogroup(each.groupBy("segment", "block")).applyInArrow(dense, "segment int, block long, counts binary")

    def add(table: pa.Table) -> list:
        return [(np.sum(_unpacked(table, "counts", np.int64), axis=0).tobytes(), pa.binary())]

    total = _tree(session.stage(vectors, "pair-vectors"), -(-blocks // _FAN), "segment int, block long, counts binary", add, "pair-totals")
    return session.stage(index.join(total.drop("block"), "segment"), "pair-counts")


def _highest(table: DataFrame) -> np.ndarray:
    """The highest count of every A id, at most one number an id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                best = np.zeros(1 << 16, np.int64)
                np.maximum.at(best, (np.frombuffer(keys, np.uint32) >> 16).astype(np.int64), np.frombuffer(counts, np.int64))
                some = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], ["a", "n"])

    best = np.zeros(1 << 16, np.int64)
    for r in table.mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]
    return best


def _parts(table: DataFrame, most_pairs: int) -> list[list[int]]:
    """Segments in groups of at most most_pairs pairs, one segment at least."""
    parts: list[list[int]] = [[]]
    size = 0
    for r in table.select("segment", (F.octet_length("keys") / 4).alias("n")).orderBy("segment").collect():  # at most SEGMENTS rows
        if parts[-1] and size + r["n"] > most_pairs:
            parts.append([])
            size = 0
        parts[-1].append(r["segment"])
        size += r["n"]
    return parts


def align_documents(documents: DataFrame, byte_file: str, piece_file: str, column: str = "text", most_pairs: int = 3_000_000) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to documents.

    Texts that are null or empty, or whose tokens do not spell a space and the text,
    have no tokens: zeros and an empty string.  Repeated rows count as often as they
    occur.  Columns of those names are replaced; all others are kept.
    most_pairs: pairs that are sent to tasks at a time, about 35 bytes each there.
    """
    spark = documents.sparkSession
    added = T._parse_datatype_string(_RESULT).fields
    documents = documents.drop(*(f.name for f in added))
    table = pair_counts(documents, byte_file, piece_file, column)
    best = _highest(table)
    parts = _parts(table, most_pairs)
    carried = ["n_best", "count_sum"]
    out = documents.withColumns({c: F.lit(0).cast("long") for c in carried})
    for number, segments in enumerate(parts):
        rows = table.where(F.col("segment").isin(segments)).toArrow()
        counts = np.concatenate([np.zeros(0, np.int64), *_unpacked(rows, "counts", np.int64)])
        sent = spark.sparkContext.broadcast((rows.select(["segment", "sizes", "bits", "keys"]), counts, best))
        last = number == len(parts) - 1
        names = documents.columns

        def run(arriving: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            hashed, counts, best = sent.value
            lookup = _lookup(hashed)
            for batch in batches(arriving, column, 1 << 20):
                n = batch.num_rows
                found, doc, keys, times, spelled = aligner(byte_file, piece_file).align(batch.column(column))
                at = lookup.find(keys)
                doc, keys, times, at = doc[at >= 0], keys[at >= 0], times[at >= 0], at[at >= 0]
                count = counts[at]
                highest = count == best[keys >> 16]
                sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
                np.add.at(sums[0], doc[highest], times[highest])
                np.add.at(sums[1], doc, times * count)
                more = [pa.array(batch.column(c).to_numpy() + s) for c, s in zip(carried, sums, strict=True)]
                kept = [batch.column(c) for c in names]
                if last:
                    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in map(spelled, range(n))]
                    more = [*(pa.array(found[:, i]) for i in range(4)), *more, pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *more], [*names, *([f.name for f in added] if last else carried)])

        fields = [*documents.schema.fields, *(added if last else [f for f in added if f.name in carried])]
        out = out.mapInArrow(run, T.StructType(fields))
        if not last:
            out = session.stage(out, "aligned")
    return out
