import datetime as dt

from pyspark.sql import functions as F

from worklore import schema
from worklore.functions import pathops
from worklore.plans import refresh, views

T0 = dt.datetime(2026, 1, 1)


def test_coverage_status(spark):
    none = spark.createDataFrame([], refresh.RUNS)
    assert views.coverage_status(none).first()["coverage_status"] == "not_refreshed"
    runs = spark.createDataFrame([(1, T0, T0, "partial", "x", {}), (2, T0, T0, "passed", "x", {})], refresh.RUNS)
    assert views.coverage_status(runs).first()["coverage_status"] == "passed"
    assert views.coverage_status(runs, source_missing=True).first()["coverage_status"] == "partial"
    assert views.coverage_status(runs, scope_changed=True).first()["coverage_status"] == "refresh_required"


def test_memory_edits(spark):
    at = lambda h: F.lit(T0 + dt.timedelta(hours=h)).cast("timestamp")
    log = views.add_memory(spark, "fact", "first", at(0)).unionByName(views.add_memory(spark, "fact", "second", at(1), origin="inferred"))
    first, second = [r.memory_id for r in views.current_memory(log).orderBy("created_at").collect()]
    assert {r.text: r.status for r in views.current_memory(log).collect()} == {"first": "accepted", "second": "proposed"}
    edit = views.update_memory(views.current_memory(log), second, at(2), status="accepted", supersedes=first)
    now = {r.memory_id: r.status for r in views.current_memory(log.unionByName(edit)).collect()}
    assert now == {first: "superseded", second: "accepted"}
    bad = spark.createDataFrame([("m", "fact", "t", "accepted", "inferred", "global", ["nope"], "", T0, T0, None, None, None)], schema.MEMORY)
    errors = {r.error for r in views.validate_memory(bad, spark.createDataFrame([], "record_id string")).collect()}
    assert errors == {"memory_reference_must_be_known_record_id", "inferred_memory_must_start_proposed"}


def test_segment_globs(spark):
    cases = {
        ("docs/**/*.md", "docs/a.md"): True, ("docs/**/*.md", "docs/x/y/a.md"): True, ("docs/*.md", "docs/x/a.md"): False,
        ("**", "a/b.md"): True, ("**/a.md", "a.md"): True, ("docs/**", "docs/x/a.md"): True, ("docs/**", "other/a.md"): False,
    }
    for (glob, path), want in cases.items():
        assert spark.range(1).select(F.lit(path).rlike(pathops.segment_glob(glob))).first()[0] is want, (glob, path)


def test_latest_instruction_is_found_behind_many_acknowledgements(spark):
    from worklore.plans import context

    rows = [("p", f"r{i:02}", f"2026-01-01 00:{i:02}:00", "thanks") for i in range(1, 40)]
    rows += [("p", "r00", "2026-01-01 00:00:00", "Repair the probe."), ("p", "old", None, "Inspect the probe.")]
    records = spark.createDataFrame(rows, "project_id string, record_id string, event_time string, text string").selectExpr(
        "*", "'user' AS actor", "'w' AS worktree_id"
    ).withColumn("event_time", F.col("event_time").cast("timestamp"))
    found = context.latest_instruction(records, records.select("record_id")).collect()
    assert [(r.project_id, r.record_id, r.text) for r in found] == [("p", "r00", "Repair the probe.")]
