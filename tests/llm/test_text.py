import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import DOCUMENTS
from worklore.llm import components, host_quality, line_windows, ngram_join, sharding

import plain


@pytest.fixture(scope="module")
def families():
    """Copies, near copies of one text, texts that share a passage, and unrelated ones."""
    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base, passage, rows = fresh(90), fresh(50), []
    rows += [" ".join(base)] * 60
    for _ in range(80):
        near = list(base)
        for _ in range(rnd.randrange(1, 4)):
            near[rnd.randrange(len(near))] = fresh(1)[0]
        rows.append(" ".join(near).upper())
    rows += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(60)]
    rows += [" ".join(fresh(rnd.randrange(1, 60))) for _ in range(60)]
    rows += ["a b", "A  b", "a b c", "", None, "a b c d", "a b c d e"]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_similar_documents(spark, families, n, percent):
    rows = ngram_join.similar_documents(spark.createDataFrame(families, DOCUMENTS).repartition(5), n, percent).collect()
    want, sets = plain.component_ids([r[:2] for r in families], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == {r[0]: (len(s), w) for r, s, w in zip(families, sets, want, strict=True)}
    assert len({w for w in want}) < len(families) - 60


def test_similar_documents_odd_rows(odd, odd_rows, none):
    rows = ngram_join.similar_documents(odd, 4, 85).collect()
    want, sets = plain.component_ids([r[:2] for r in odd_rows], 4, 85)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == sorted(
        str((r[0], len(s), w if s else r[0])) for r, s, w in zip(odd_rows, sets, want, strict=True)
    )
    assert ngram_join.similar_documents(none).count() == 0
    assert ngram_join.keep_one_of_each(none).count() == 0


def test_members_of_one_group_link_past_its_lead(spark):
    """Documents 1 to 4 form one group that shares no n-gram with another; 3 and 4 resemble each other but not 1."""
    text = [f"t{i}" for i in range(103)]
    changed = {1: (20, 40), 2: (20, 40), 3: (30, 50), 4: (30, 50)} | {i: (70, 80) for i in range(5, 25)}
    rows = []
    for number, places in changed.items():
        own = [f"own{number}x{i}" if i in places else word for i, word in enumerate(text)]
        rows.append((number, " ".join(own), "en", "s", 0))
    want, _ = plain.component_ids([r[:2] for r in rows], 4, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(rows, DOCUMENTS), 4, 85).collect()}
    assert got == dict(zip(changed, want, strict=True)) and got[4] == 3 and got[2] == 1


def _link_counts(rows, n, percent):
    """How many other rows every row links with, by all pairs."""
    _, sets = plain.component_ids(rows, n, percent)
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return [sum(alike(a, b) for b in sets) - bool(a) for a in sets]


@pytest.mark.parametrize("block", [256, 7])
def test_every_link_is_counted(spark, families, odd, odd_rows, block):
    """Near copies of one text link with each other, not only with those that connect them; copies count."""
    found = ngram_join.similar_documents(spark.createDataFrame(families, DOCUMENTS).repartition(5), 4, 85, block).collect()
    want = _link_counts([r[:2] for r in families], 4, 85)
    assert {r.doc_id: r.n_links for r in found} == {r[0]: w for r, w in zip(families, want, strict=True)}
    assert 60 < max(want) < 139
    found = ngram_join.similar_documents(odd, 4, 85, block).collect()
    want = _link_counts([r[:2] for r in odd_rows], 4, 85)
    assert sorted(str((r.doc_id, r.n_links)) for r in found) == sorted(str((r[0], w)) for r, w in zip(odd_rows, want, strict=True))


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 5)], "a long, b long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {i: 0 if i <= 30 or i == 100 else 31 for i in [*range(61), 100]}
    assert components.components(links.limit(0)).count() == 0


def test_rule_counts(odd, odd_rows):
    rows = host_quality.judge(odd.withColumn("n_words", F.lit("clash"))).collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == sorted(str((r[0], *plain.rule_counts(r[1]), plain.base_failed(r[1]))) for r in odd_rows)


def test_hosts_are_shrunk_and_judged(spark, none):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, None, "fine", 0) for i in range(40)] + [(100 + i, good if i < 6 else "bad", None, "poor", 0) for i in range(40)]
    rows += [(200, "bad", None, "rare", 0), (201, good, None, None, 0)]
    got = {r.doc_id: r.kept for r in host_quality.judge(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(40)) and got[201] and not got[200]
    kept = host_quality.keep_good(spark.createDataFrame(rows, DOCUMENTS))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 201] and kept.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    assert host_quality.judge(none).count() == host_quality.keep_good(none).count() == 0
    rates = spark.createDataFrame([("a", 1000, 500), ("b", 1, 1), ("c", 1000, 10), ("d", 1000, 20)], "host string, n long, failed long")
    rate = {r.host: r.rate for r in host_quality.host_rates(rates).collect()}
    assert 0.49 < rate["a"] < 0.5 and rate["b"] < 0.9 and 0.01 < rate["c"] < 0.02


def test_repeated_passages(given, odd, odd_rows, none):
    rows = [(r.doc_id, r.text) for r in given.collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_windows.drop_repeated_passages(given).collect()}
    assert got == dict(zip([r[0] for r in rows], plain.fresh_lines(rows), strict=True))
    assert any(n for _, n in got.values())
    clash = odd.where("not (doc_id <=> 8 and text like 'other%')").withColumn("places", F.lit(1)).withColumn("a", F.lit(2))
    mine = [r[:2] for r in odd_rows if not (r[1] or "").startswith("other")]
    rows = line_windows.drop_repeated_passages(clash).collect()
    want = sorted(str((m[0], *w)) for m, w in zip(mine, plain.fresh_lines(mine), strict=True))
    assert sorted(str((r.doc_id, r.text, r.n_removed)) for r in rows) == want
    assert line_windows.drop_repeated_passages(none).count() == 0
    fresh = line_windows.keep_fresh_lines(odd)
    assert fresh.columns == odd.columns and fresh.where("doc_id = 10").count() == 0


def test_shards(odd, odd_rows, none):
    rows = sharding.shard_documents(odd, 3).collect()
    size = {str(k): len((k[1] or "").encode()) + 1 for k in odd_rows}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(k[0]), size[str(k)], zlib.crc32((k[1] or "").encode())) for k in odd_rows)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in rows)
    total, start = sum(r.size for r in rows), 0
    for r in ordered:
        assert r.shard == min(2, start * 3 // total)
        start += r.size
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard_documents(none).count() == 0


def test_written_shards_hold_everything(spark, given, tmp_path):
    sharding.write_shards(given, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("shard").distinct().count() == 4
    assert back.select(given.columns).exceptAll(given).count() == 0 and back.count() == given.count()
