"""Byte-pair encoding and decoding: speculate by longest match, verify, repair.

For every distinct word, tokens are proposed by greedy longest match through a
prefix tree.  A sequence is what merging yields exactly when no merge could have
crossed the border of two neighbours, so every neighbouring pair is tested, all
pairs of a batch at once.  Only words with a failing pair are merged step by step.
Works for word-wise tokenizer files (end-of-word suffix, lower case, no decoder).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from worklore.llm import wordcodes
from worklore.llm.textscan import batches, span_hashes

_NEVER = np.int64(1) << 40
# Fixed values of the file's format: how a text is cut into words.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter by which vocabulary files write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return [chr(b) for _, b in sorted([*((b, b) for b in shown), *((b, 256 + i) for i, b in enumerate(rest))])]


class Merges:
    """A vocabulary with its merges, as arrays.

    Symbols are bytes, a word's last byte being a symbol of its own.  left and
    right are the parts a token was merged from, rank the merge's place (-1 for
    symbols).  Tokens that merging does not reach are not proposed.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        suffix = model["end_of_word_suffix"] or ""
        if not suffix or file["decoder"] is not None:
            raise ValueError("a word-wise vocabulary without decoder is expected")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.written = [""] * size
        for token, i in (vocab | self.special).items():
            self.written[i] = token
        letters = byte_letters()
        self.symbol_ids = np.array([vocab[x] for x in letters] + [vocab[x + suffix] for x in letters], np.int64)
        self.order: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.order.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([a << 20 | b for a, b in self.order], np.int64)
        by = np.argsort(keys)
        self.pair_keys = keys[by]
        self.pair_ranks = np.array([r for r, _ in self.order.values()], np.int64)[by]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        spelled: dict[int, tuple[int, ...]] = {int(i): (k,) for k, i in enumerate(self.symbol_ids)}
        for (a, b), (rank, c) in self.order.items():
            if c not in spelled and a in spelled and b in spelled:
                spelled[c] = spelled[a] + spelled[b]
                self.left[c], self.right[c], self.rank[c] = a, b, rank
        reached = {c: s for c, s in spelled.items() if self._reachable(c)}
        self._grow_tree(reached)

    def _reachable(self, token: int) -> bool:
        """The parts are reachable and no merge crosses their border first."""
        if self.rank[token] < 0:
            return True
        a, b = self.left[token : token + 1], self.right[token : token + 1]
        if not hasattr(self, "_known"):
            self._known: dict[int, bool] = {}
        if token not in self._known:
            limit = self.rank[token : token + 1]
            ok = bool(self.compatible(a, b, limit)[0])
            self._known[token] = ok and self._reachable(int(a[0])) and self._reachable(int(b[0]))
        return self._known[token]

    def _grow_tree(self, tokens: dict[int, tuple[int, ...]]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for token, spelling in tokens.items():
            node = 0
            for symbol in spelling:
                step = nodes.get((node, symbol))
                if step is None:
                    step = nodes[node, symbol] = len(ends)
                    ends.append(-1)
                node = step
            ends[node] = token
        keys = np.array([n << 9 | s for n, s in nodes], np.int64)
        by = np.argsort(keys)
        self.tree_keys, self.tree_next = keys[by], np.array(list(nodes.values()), np.int64)[by]
        self.tree_token = np.array(ends, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge's rank for each pair, or a value beyond all ranks."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b stay apart when merging runs over their joined spelling.

        Undoes both tokens from the border outwards, the later merge first: each
        state is a pair that lay side by side from its own making until the
        earlier of the two merges that used it up.  A merge of the pair within
        that time would have crossed the border; of equal ranks the left comes
        first.  limit: only merges before this rank count.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        end = np.full(len(a), _NEVER, np.int64) if limit is None else limit.astype(np.int64)
        used_a, used_b = end.copy(), end - 1
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            merge = self.pair_rank(x, y)
            bad = (merge < used_a[live]) & (merge <= used_b[live])
            ok[live[bad]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            more = ~bad & ((made_x >= 0) | (made_y >= 0))
            live, made_x, made_y = live[more], made_x[more], made_y[more]
            undo_b = made_y >= made_x
            right, left = live[undo_b], live[~undo_b]
            used_b[right], b[right] = made_y[undo_b], self.left[b[right]]
            used_a[left], a[left] = made_x[~undo_b], self.right[a[left]]
        return ok

    def greedy(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of every word, and the word of each token."""
        tokens, owners = [], []
        at, stop = bounds[:-1].copy(), bounds[1:]
        active = np.flatnonzero(at < stop)
        while len(active):
            node = np.zeros(len(active), np.int64)
            best, length = np.full(len(active), -1), np.zeros(len(active), np.int64)
            alive, depth = np.arange(len(active)), 0
            while len(alive):
                place = at[active[alive]] + depth
                alive, place = alive[place < stop[active[alive]]], place[place < stop[active[alive]]]
                if not len(alive):
                    break
                key = node[alive] << 9 | symbols[place]
                hit = np.minimum(np.searchsorted(self.tree_keys, key), len(self.tree_keys) - 1)
                same = self.tree_keys[hit] == key
                alive, depth = alive[same], depth + 1
                node[alive] = self.tree_next[hit[same]]
                token = self.tree_token[node[alive]]
                whole = token >= 0
                best[alive[whole]], length[alive[whole]] = token[whole], depth
            tokens.append(best)
            owners.append(active)
            at[active] += length
            active = active[at[active] < stop[active]]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        by = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[by], owner[by]

    def merged(self, symbols: Sequence[int]) -> list[int]:
        """Exact merging of one word: lowest rank first, then leftmost."""
        ids = [int(self.symbol_ids[s]) for s in symbols]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.order[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.order]
        heapq.heapify(queue)
        gone = [False] * n
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i] if not gone[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.order[pair][1]
            gone[j], after[i] = True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := (ids[x], ids[y])) in self.order:
                    heapq.heappush(queue, (self.order[new][0], x, new))
        return [t for t, g in zip(ids, gone, strict=True) if not g]


class Speculative(wordcodes.Encoder):
    """Encodes with `Merges` alone; pieces and lookup are those of the base class."""

    def __init__(self, path: str, most_words: int = 500_000) -> None:
        import regex

        self.merges = Merges(path)
        self.attach_space = False
        self.special = re.compile("|".join(map(re.escape, self.merges.special)) or r"(?!)")
        self.word = regex.compile(_WORD)
        self.table = wordcodes.WordTable(most_words)
        self.unknown = self._propose
        self.repaired = self.proposed = 0

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[bounds[1:] - 1] += 256
        tokens, owner = self.merges.greedy(symbols, bounds)
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[beside] << 20 | tokens[beside + 1], return_inverse=True)
        fine = self.merges.compatible(pairs >> 20, pairs & ((1 << 20) - 1))
        failed = np.unique(owner[beside[~fine[which]]])
        self.proposed += len(words)
        self.repaired += len(failed)
        lengths = np.bincount(owner, minlength=len(words))
        if len(failed):
            firsts = np.concatenate([[0], np.cumsum(lengths)])
            exact = {w: np.array(self.merges.merged(symbols[bounds[w] : bounds[w + 1]].tolist())) for w in failed.tolist()}
            parts, at = [], 0
            for w, ids in exact.items():
                parts += [tokens[at : firsts[w]], ids]
                at = firsts[w + 1]
                lengths[w] = len(ids)
            tokens = np.concatenate([*parts, tokens[at:]])
        return tokens.astype(np.int32), lengths

    def whole(self, text: str) -> np.ndarray:
        """Any text: special tokens first, then words of each stretch between them."""
        parts, at = [], 0
        for hit in [*self.special.finditer(text), None]:
            stretch = text[at : hit.start() if hit else len(text)]
            lowered = "".join(c.lower() for c in unicodedata.normalize("NFC", stretch))
            words = self.word.findall(lowered)
            if words:
                units = [len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words]
                ends = np.cumsum(units)
                data = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), np.uint16)
                rows = self.rows(span_hashes(data, ends - units, ends), words.__getitem__)
                parts.append(wordcodes.take_spans(self.table.flat, self.table.offsets, rows)[0])
            if hit:
                parts.append(np.array([self.merges.special[hit[0]]], np.int32))
                at = hit.end()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The written tokens with spaces between; numbers outside the file are skipped."""
        written = self.merges.written
        return " ".join(written[i] for i in ids if 0 <= i < len(written) and written[i])


def encode_texts(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and n_tokens to df.

    A null or empty text has no ids.  Columns named ids or n_tokens are replaced.
    tokenizer: a file that driver and executors can open.
    """
    return _with(df.drop("ids", "n_tokens"), tokenizer, column, decoded=False)


def round_trip(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """`encode_texts`, and the ids decoded again in the same pass, as decoded."""
    return _with(df.drop("ids", "n_tokens", "decoded"), tokenizer, column, decoded=True)


def decode_ids(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """Adds decoded, the text of a column as `encode_texts` makes it; null gives an empty text."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def decoded(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = wordcodes.encoder(tokenizer, Speculative)
        for batch in arriving:
            texts = [e.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(column).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return df.mapInArrow(decoded, schema)


def _with(df: DataFrame, tokenizer: str, column: str, decoded: bool) -> DataFrame:
    extra = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    extra += [T.StructField("decoded", T.StringType())] * decoded
    schema = T.StructType([*df.schema.fields, *extra])

    def encoded(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = wordcodes.encoder(tokenizer, Speculative)
        for batch in batches(arriving, column, 1 << 20):
            ids, offsets = e.encode(batch.column(column).to_pylist())
            pairs = list(zip(offsets.tolist(), offsets[1:].tolist(), strict=False))
            raw = ids.astype("<u4").tobytes()
            out = batch.append_column("ids", pa.array([raw[4 * a : 4 * b] for a, b in pairs], pa.binary()))
            out = out.append_column("n_tokens", pa.array(np.diff(offsets), pa.int64()))
            if decoded:
                out = out.append_column("decoded", pa.array([e.decode(ids[a:b].tolist()) for a, b in pairs], pa.string()))
            yield out

    return df.mapInArrow(encoded, schema)


def code_digests(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document.

    Repeated rows give repeated results; a null doc_id stays null.
    """
    coded = round_trip(df.select("doc_id", "text"), tokenizer)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
