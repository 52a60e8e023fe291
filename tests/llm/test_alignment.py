"""Alignment against plain Python over the libraries, and the hash by itself."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from worklore.llm import alignment, minimal_hash
from worklore.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(texts):
    """[(a ids, b ids)] of every group, per text."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    values = {c: i for i, c in enumerate(byte_letters())}
    out = []
    for text in texts:
        groups, whole = [], (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        a_bytes = [bytes(values[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and b"".join(a_bytes) == whole and b"".join(b_bytes) == whole:
            ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
            shared = sorted(set(ends[0]) & set(ends[1]))
            at = [0, 0]
            for end in shared:
                upto = [side.index(end) + 1 for side in ends]
                groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
                at = upto
        out.append(groups)
    return out


def plain_rows(texts):
    groups = plain_groups(texts)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(p for one in links for p in one)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for g, one in zip(groups, links, strict=True):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()),
            sum(n for p, n in one.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in one.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
        )


@pytest.fixture(scope="module")
def rows(odd_rows, given):
    long = " ".join(f"word{i * 7919 % 997}" for i in range(6_000))  # the plain way takes long on longer ones
    odd = [(*r[:1], long if r[1] and len(r[1]) > 50_000 else r[1], *r[2:]) for r in odd_rows]
    extra = [(100, "a ", "", "", 1), (101, " ", "", "", 1), (102, "has ▁ in it", "", "", 1), (103, "a　 b\n  c\x85 d \x1c e", "", "", 1)]
    return odd + extra + [tuple(r) for r in given.collect()[:60]]


@pytest.mark.parametrize("most_pairs", [3_000_000, 2_000])
def test_alignment(spark, rows, most_pairs):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block string, keys long").repartition(5)
    got = alignment.align_documents(docs, A, B, most_pairs=most_pairs)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == ["doc_id", "text", "block", "keys", *names]
    found = [(str(r.doc_id), *(r[n] for n in names)) for r in got.collect()]
    assert sorted(found) == sorted((str(r[0]), *x) for r, x in zip(rows, plain_rows([r[1] for r in rows]), strict=True))


def test_parts_of_the_lookup_table(spark, given):
    table = alignment.pair_counts(given.limit(40), A, B)
    total = table.selectExpr("sum(octet_length(keys) / 4) as n").first()["n"]
    parts = alignment._parts(table, int(total // 5))
    assert len(parts) > 4 and sorted(s for p in parts for s in p) == sorted(r.segment for r in table.select("segment").collect())


def test_empty_table(spark, none):
    assert alignment.align_documents(none, A, B).count() == 0


def test_pieces_do_not_change_tokens():
    rng = np.random.default_rng(3)
    letters = list("ab zs'tldrve  \n\t'12.,!\xe9\xa0\xf1　▁\x85\x1c") + ["'ll", " '", "<|endoftext|>", "日", "\U0001d4b3", "</s>", "<0x41>", "  \n "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)]
    counts, *_ = alignment.Aligner(A, B, 300).align(pa.array(texts))
    want = [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g)) for g in plain_groups(texts)]
    assert [tuple(c[:3]) for c in counts.tolist()] == want


def test_hash_is_minimal_and_knows_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 50_000, dtype=np.uint32))
    known, strange = keys[::2], keys[1::2]
    segment = minimal_hash.segment_of(known)
    lookup = minimal_hash.Lookup.of([(s, *minimal_hash.build(known[segment == s])) for s in range(0, 256)])
    assert sorted(lookup.find(known)) == list(range(len(known)))
    assert (lookup.find(strange) == -1).all()
