"""Work that several readers share is done once, and cheap tests come before costly ones."""

from pyspark.sql import functions as F

import entry_store
from worklore.functions import jsonops as J, ordering, pathops
from worklore.operators import docs
from worklore.sources import docfiles


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_statements_read_their_records_once(spark):
    rows = [("r1", "document_section", "We ran probe 1.", "Status", "status.md", 1, "prose"),
            ("r2", "document_section", "- Probe 2 is unfinished.\n- Probe 3 is blocked.", "Status", "status.md", 4, "prose"),
            ("r3", "document_section", "7 checks PASS", "Tests", "status.md", 9, "code")]
    names = "record_id string, kind string, full_text string, section string, relative_path string, line_start int, source_context string"
    found = docs.document_statements(spark.createDataFrame(rows, names))
    assert "LogicalRDD" not in _plan(found) and "LocalRelation" not in _plan(found)
    got = sorted((r["record_id"], r["owner"], r["kind"], r["text"]) for r in found.select("record_id", "owner", "cand.kind", "cand.text").collect())
    assert got == [("r1", 1, "claim", "We ran probe 1."), ("r2", 1, "task", "Probe 2 is unfinished."),
                   ("r2", 2, "blocker", "Probe 3 is blocked."), ("r3", 1, "claim", "7 checks PASS")]


def test_lines_are_gathered_without_inserts(spark):
    text = "# A\n\nOne\n   ===\n > q\n   # B #\n~~~\n# c\n~~~\n \n--x\nTwo\n---\n\ttab"
    d = spark.createDataFrame([(1, text), (2, "\n".join(f"line {i}" for i in range(200)))], "doc_id int, text string")
    lines = d.select("doc_id", F.inline(docs._labelled(F.col("text"))))
    assert _plan(lines).count("array_insert(") == 1  # per block of lines, not per line
    got = [(r["label"], r["level"], r["title"]) for r in lines.filter("doc_id = 1").orderBy("pos").collect()]
    assert got == [
        ("heading", 1, "A"), ("none", None, None), ("heading", 1, "One"), ("none", None, None), ("quote", None, None),
        ("heading", 1, "B"), ("fence:code", None, None), ("fence:code", None, None), ("fence:code", None, None),
        ("none", None, None), ("prose", None, None), ("heading", 2, "Two"), ("none", None, None), ("code", None, None),
    ]
    assert lines.filter("doc_id = 2 and label = 'prose' and line = concat('line ', pos)").count() == 200

def test_kinds_of_values_are_told_without_writing_them_out(spark):
    given = ['{"a": 1}', "[1]", '"x"', "7", "1.0", "1.5", "1E400", "true", "null"]
    v = spark.createDataFrame([(i, '{"f": %s}' % g) for i, g in enumerate(given)], "i int, t string").withColumn("v", J.parse(F.col("t")))
    f = J.node(F.col("v"), "$.f")
    objects = v.select(J.is_object(F.col("v")), J.is_array(f))
    assert "to_json" not in _plan(objects) and "StructsToJson" not in _plan(objects)
    out = v.select("i", J.first_char(f).alias("c"), J.int_at(F.col("v"), "$.f").alias("n"), J.bool_at(F.col("v"), "$.f").alias("b")).orderBy("i").collect()
    assert [r["c"] for r in out] == ["{", "[", '"', None, None, None, '"', None, None]
    assert [r["n"] for r in out] == [None, None, None, 7, 1, None, None, None, None]
    assert [r["b"] for r in out] == [None] * 7 + [True, None]


def test_paths_are_computed_once(spark):
    given = ["/a/b", "/a//b/./c/", "/", "//", "/a/.", "/a/../b", "/a..b/..c", "a/b", "", None, "file:///a%20b+c", "file:/a/", "file:a", "/a[b", "/a\tb", "/a/ ", "/x" * 2048, "/" + "x" * 4096]
    d = spark.createDataFrame([(i, p and p[::-1]) for i, p in enumerate(given)], "i int, p string")
    out = d.select("i", pathops.clean_absolute(F.reverse("p")).alias("p"))
    assert _plan(out).count("reverse(") == 1
    got = [r["p"] for r in out.orderBy("i").collect()]
    assert got == ["/a/b", "/a/b/c", "/", "/", "/a", None, "/a..b/..c", None, None, None, "/a b+c", "/a", None, None, None, "/a ", "/x" * 2048, None]


def test_next_rows_need_no_join(spark):
    rows = [(g, p, f"{g}{p}" if p % 3 else None) for g in ("a", "b", None) for p in (0, 1, 2, 3, 9, 10, 11, 25, 26, 60)] + [("c", 5, "c5")]
    d = spark.createDataFrame(rows, "g string, p long, v string").withColumn("seg", ordering.position_segment(F.col("p"), 4))
    out = ordering.next_row(d, ["g"], "seg", "p", F.struct("v", "p"), "following")
    assert "Join" not in _plan(out)
    got = {(r["g"], r["p"]): r["following"] and tuple(r["following"]) for r in out.collect()}
    want = {}
    for g in ("a", "b", None, "c"):
        mine = [r for r in rows if r[0] == g]
        want |= {(g, r[1]): (n[2], n[1]) if n else None for r, n in zip(mine, [*mine[1:], None], strict=True)}
    assert got == want and out.columns == [*d.columns, "following"]


def test_listed_files_are_read_in_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    listed = spark.createDataFrame([(f"{tmp_path}/{i}.txt",) for i in range(40)], "path string")
    read = docfiles.with_content(listed).withColumn("task", F.spark_partition_id()).collect()
    assert {bytes(r["content"]).decode() for r in read} == {f"text {i}" for i in range(40)}
    assert len({r["task"] for r in read}) > 1


def test_blocks_are_written_as_lines(spark, tmp_path):
    rows = [(1, "aé"), (1, "\x00b\nc"), (2, ""), (None, "d")]
    texts = spark.createDataFrame(rows, "block long, text string").coalesce(1).sortWithinPartitions("block")
    entry_store._write_blocks(texts, f"file:{tmp_path}/docs")
    read = {p.parent.name: p.read_bytes().decode() for p in tmp_path.glob("docs/*/part-*.txt")}
    assert sorted(read["block=1"].split("\n")) == sorted("aé\n\x00b\nc\n".split("\n"))
    assert read["block=2"] == "\n" and read["block=__HIVE_DEFAULT_PARTITION__"] == "d\n"
