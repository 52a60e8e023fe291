import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from worklore.llm import nearest, url_templates

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(1)
        other = np.flatnonzero(ids != ids[i])
        top = other[np.lexsort((ids[other], -score[other]))][:k]
        out[int(ids[i])] = [(int(ids[t]), score[t]) for t in top]
    return out


def asked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_small_sets_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    bad = [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [1.0] * 7 + [None]), (580, [float("inf")] * 8), (600, []), (620, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], VECTORS).repartition(4)
    assert asked(nearest.nearest(df, every=20, k=5)) == brute(rows, 20, 5)
    assert nearest.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0)], VECTORS)
    assert asked(nearest.nearest(few)) == {0: [(1, 0.5)]}


def test_recall_and_hot_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 12_000)] + 0.7 * rng.normal(size=(12_000, 32))
    x[:4000] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    monkeypatch.setattr(nearest, "_BLOCK", 1000)
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    got, want = asked(nearest.nearest(df, every=400, k=10, share=0.2, least=500)), brute(rows, 400, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert got[0] == want[0]  # of four thousand equal vectors the smallest ids
    hits = [len(set(got[q]) & set(want[q])) / 10 for q in want]
    assert np.mean(hits) >= 0.9


def test_urls_are_taken_apart(spark):
    rows = [
        ("http://A.Org/x/y?q#z", "a.org", "/x/y"), ("s://h", "h", ""), ("s://h?x/y", "h", ""), ("s://h#/x", "h", ""), ("no scheme/x", "", ""),
        (None, "", ""), ("", "", ""), ("a://b://c/d", "b:", "//c/d"), ("s://É.x/p", "É.x", "/p"), ("s:///p", "", "/p"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    got = df.select(url_templates.host_of(F.col("url")), url_templates.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_rules_come_first(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    cases = {
        "s://x.org/a": ("org/", "allow"), "s://org/": ("org/", "allow"), "s://xorg/": (None, None), "s://x.org": (None, None),
        "s://m.example.org/es/1": ("example.org/es/", "block"), "s://anexample.org/es/1": ("org/", "allow"), "s://example.org/en/12": ("example.org/en/1", "block"),
        "s://example.org/en/2": ("org/", "allow"), "s://a.com/de/": ("com/de/", "block"), "s://a.com/de": (None, None), "s://a.com/fr/x": ("com/fr/", "allow"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_templates.host_of(F.col("url")).alias("host"), url_templates.path_of(F.col("url")).alias("path"))
    rule, verdict = url_templates.matching_rule(rules, F.col("host"), F.col("path"))
    assert {r[0]: tuple(r)[1:] for r in df.select("url", rule, verdict).collect()} == cases


@pytest.fixture(scope="module")
def tree(spark):
    pages, labels = [], []
    for host in ("big.net", "small.net"):
        for section, good in (("news", 0.95), ("talk", 0.93), ("spam", 0.02)):
            for i in range(300 if host == "big.net" else 40):
                pages.append((len(pages), f"http://{host}/{section}/{i * 37}.html?x", "h"))
                labels.append((len(pages) - 1, i % 100 < good * 100))
    pages += [(9001, None, None), (9002, "http://new.net/a/b", None), (9003, "http://big.net/news/1/2/3/4/5/6/7/8", None), (9001, None, None)]
    return spark.createDataFrame(pages, "page_id long, url string, purity string"), spark.createDataFrame(labels, "page_id long, good boolean")


def test_templates(spark, tree):
    pages, labels = tree
    rows = {r.page_id: r for r in url_templates.judge_urls(pages, labels).collect()}
    assert len(rows) == pages.select("page_id").distinct().count()
    for page_id, url, _ in pages.collect():
        assert rows[page_id].verdict == ("block" if url and "/spam/" in url else "allow"), rows[page_id]
    assert rows[0].template == "/news|talk/*" and rows[700].template == "/spam/*"
    assert url_templates.judge_urls(pages, labels).count() == pages.count()


def test_a_bad_branch_is_told_apart_among_many_and_far_down(spark):
    """One spam section of 21, of 40, and a bad branch at the seventh segment."""
    pages, labels = [], []

    def add(url, good):
        pages.append((len(pages), url))
        labels.append((len(pages) - 1, good))

    for sections in (21, 40):
        for section in range(sections):
            for i in range(30):
                add(f"http://host{sections}.net/s{section}/{i * 37}.html", section != 7)
    for name in ("fine", "good", "spam"):
        for i in range(30):
            add(f"http://deep.net/a/b/c/d/e/f/{name}/{i * 37}.html", name != "spam")
    pages += [(9001, "http://host40.net/s7/new.html"), (9002, "http://host40.net/unknown/new.html"), (9003, "http://deep.net/a/b/c/d/e/f/spam/new.html")]
    got = url_templates.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean"))
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == len(pages)
    for page_id, url in pages:
        assert rows[page_id].verdict == ("block" if "/s7/" in url or "/spam/" in url else "allow"), rows[page_id]
    assert "|+" not in rows[0].template and rows[700].template.endswith("|+19/*")


def test_urls_without_labels_or_pages(tree):
    pages, labels = tree
    assert url_templates.judge_urls(pages, labels.limit(0)).where("verdict != 'allow'").count() == 0
    assert url_templates.judge_urls(pages.limit(0), labels).count() == 0


def _agrees_with_plain(pages, labels, **options):
    found = url_templates.judge_urls(pages, labels, **options).collect()
    marks = {}
    for row in labels.collect():
        marks.setdefault(row.page_id, []).append(int(row.good))
    want = plain.url_verdicts([(r.page_id, r.host, r.path) for r in found], marks, **options)
    assert {(r.host, r.path): (r.template, r.verdict) for r in found} == want
    return found


def test_whole_method_on_a_table(spark):
    from worklore.llm import queries

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = queries.page_labels(pages, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(_agrees_with_plain(pages, labels)) == pages.count()


def test_whole_method_on_long_and_nested_urls(spark):
    """A url of a thousand segments takes a round or two, not a thousand."""
    urls = ["http://t/" + "/".join(f"x{i}" for i in range(1000)), "http://t/" + "/".join(f"y{i % 7}" for i in range(1000))]
    urls += [f"http://n/{'/'.join('ab'[:1 + i % 2] for i in range(d))}" for d in range(8)]
    urls += [f"http://m/{i % 3}/v{i}/{'good' if i % 4 else 'bad'}/{i % 5}" for i in range(80)] + ["http://m", None, "http://m//", "http://e/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = [(i, i % 4 != 2) for i in range(10, 90) if i % 3] + [(0, False), (1, True), (0, False)]
    labels = spark.createDataFrame(marks, "page_id long, good boolean")
    _agrees_with_plain(pages, labels)
    _agrees_with_plain(pages, labels, children=3, least=4, own=2)
