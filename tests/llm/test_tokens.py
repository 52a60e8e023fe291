import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from worklore.llm import bpe, packing, token_counts, token_records
from worklore.llm.wordcodes import Encoder

import plain

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def odd_texts(odd_rows):
    rng = np.random.default_rng(3)
    letters = list("ab zs'tldrve  \n\t'12.,!é\xa0ñß_²") + ["'ll", "'re", " '", "<|endoftext|>", "Σ", "日", "ı", "𝒳"]
    noise = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    return [r[1] for r in odd_rows] + noise


@pytest.mark.parametrize("path,kind", [(BYTE, Encoder), (WORD, Encoder), (WORD, bpe.Speculative)])
def test_ids_are_the_library_s(odd_texts, path, kind):
    encoder = kind(path, 200)
    for _ in range(2):
        ids, offsets = encoder.encode(odd_texts)
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
        assert got == library(path, odd_texts)


def test_greedy_words_that_fail_are_repaired():
    encoder = bpe.Speculative(WORD)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdehiorstn"), rng.integers(1, 25))) for _ in range(5000)]
    ids, offsets = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library(WORD, texts)
    assert 0 < encoder.repaired < encoder.proposed


def test_records_come_back_in_order(spark, odd, odd_rows, tmp_path):
    folder = str(tmp_path / "records")
    token_records.write_records(odd, folder, BYTE, file_bytes=100_000)
    index = token_records.write_index(spark, folder, str(tmp_path / "index"))
    rows = token_records.with_starts(index).orderBy("start").collect()
    wanted = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x + [0] for x in library(BYTE, [r[1] for r in wanted])]
    assert [r.doc_id for r in rows] == [r[0] for r in wanted]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(u32(x))) for x in ids]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    parts = token_records.read_shuffled(spark, folder, index, seed=5, parts=2)
    got = sorted((str(r.doc_id), bytes(r.ids)) for p in parts for r in p.collect())
    assert got == sorted((str(w[0]), u32(x)) for w, x in zip(wanted, ids, strict=True))


def test_damage_is_found():
    record = token_records.frame(7, np.arange(5), 2) + b"\n"
    doc_id, ids, end = token_records.unframe(memoryview(record))
    assert (doc_id, ids.tolist(), end) == (7, [0, 1, 2, 3, 4], len(record))
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(broken)))


def test_empty_tables(spark, none, tmp_path):
    folder = str(tmp_path / "none")
    token_records.write_records(none, folder, BYTE)
    assert token_records.read_records(spark, folder).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0
    assert bpe.code_digests(none, WORD).count() == 0
    assert token_counts.count_tokens(none, BYTE, str(tmp_path / "cache")).count() == 0


def test_digests(odd, odd_rows):
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for row, ids in zip(odd_rows, library(WORD, [r[1] for r in odd_rows]), strict=True):
        decoded = tokenizer.decode(ids, skip_special_tokens=False).encode()
        want.append((str(row[0]), len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.code_digests(odd, WORD).collect()]
    assert sorted(got) == sorted(want)


def test_decode_is_the_inverse_step(odd):
    twice = bpe.decode_ids(bpe.round_trip(odd.withColumn("n_tokens", odd.doc_id), WORD).withColumnRenamed("decoded", "before"), WORD)
    assert twice.where("not (before <=> decoded)").count() == 0


def test_counts_and_cache(spark, odd, odd_rows, tmp_path):
    cache = str(tmp_path / "cache")
    lengths = [len(x) for x in library(BYTE, [r[1] for r in odd_rows])]
    want = sorted((str(r[0]), len((r[1] or "").encode()), n, n > 50) for r, n in zip(odd_rows, lengths, strict=True))
    for direct in (1_000, 0):
        got = token_counts.count_tokens(odd, BYTE, cache, limit=50, direct_rows=direct)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in odd_rows})


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_are_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([1, 2, 3, 9, 17, 30, 31, 33, 50, 64], 500, p=rng.dirichlet(np.ones(10))).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    sequences = {}
    for length, _, n, first, per, fill in packing.sweep_rounds(counts, 64).tolist():
        for i in range(n):
            sequences.setdefault(first + i // per, []).append((fill + i % per * length, length))
    for places in sequences.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 64
    assert sorted(n for p in sequences.values() for _, n in p) == sorted(lengths)
    assert len(sequences) == plain.best_fit_decreasing(lengths, 64)


@pytest.mark.parametrize("keep", [False, True])
def test_packing(odd, odd_rows, keep):
    rows = packing.pack_documents(odd, WORD, 512, keep_ids=keep).collect()
    want = []
    for row, ids in zip(odd_rows, library(WORD, [r[1] for r in odd_rows]), strict=True):
        ids = ids + [0]
        want += [(str(row[0]), p, s, u32(ids[s : s + 512])) for p, s in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (*w[:3], len(w[3]) // 4, zlib.crc32(w[3])) for w in want
    )
    if keep:
        assert sorted((str(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 512


def test_lengths_out_of_bounds_are_refused(spark):
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            packing.best_fit(spark.createDataFrame([(1, 3), (2, bad)], "id long, length long"), 8, "id")
