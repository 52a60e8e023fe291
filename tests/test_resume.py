import datetime as dt

from pyspark.sql import functions as F

from worklore import schema
from worklore.plans import context, resume

T0 = dt.datetime(2026, 1, 1)
VERDICTS = "project_id string, worktree_id string, record_id string, from_path string, to_path string, event_time timestamp, failure string"
SPANS = "project_id string, worktree_id string, from_path string, to_path string, since timestamp, until timestamp, failure string"


def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_identity_report(spark):
    verdicts = spark.createDataFrame([("p", "w", "m1", "/a", "/b", T0, None), (None, None, "m2", "/c", "/d", T0, "ambiguous_move_endpoints")], VERDICTS)
    spans = spark.createDataFrame([("p", "w", "/x", "/b", T0, T0, None), ("p", "w", "/y", "/b", T0, T0, "historical_git_identity_conflict")], SPANS)
    report = resume.identity_report(verdicts, spans)
    assert _rows(report, "part", "project_id", "code", "from_path") == sorted([
        ("association", "p", None, "/a"), ("observed_operation", "p", None, "/a"), ("association", "p", None, "/x"),
        ("uncertainty", None, "ambiguous_move_endpoints", "/c"), ("uncertainty", None, "historical_git_identity_conflict", "/y")], key=str)
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    codes = ["ambiguous_move_endpoints", "historical_git_identity_conflict"]
    assert _rows(resume._beside_all(projects, report), "project_id", "code") == [(p, c) for p in "pq" for c in codes]
    assert resume._beside_all(projects, report.filter("false")).count() == 0
    assert resume.identity_report(verdicts.filter("false")).count() == 0


def test_moved_stopping_point(spark):
    stops = spark.createDataFrame([("p", "r1", "user", T0, "x"), ("q", "r2", "user", T0 + dt.timedelta(1), "y"), ("s", "r3", "user", None, "z")],
                                  "project_id string, record_id string, actor string, event_time timestamp, text string")
    moves = spark.createDataFrame([("p", "m1", T0), ("p", "m0", T0), ("q", "m2", T0), ("s", "m3", T0), ("t", "m4", T0), (None, "m5", T0)],
                                  "project_id string, record_id string, event_time timestamp")
    assert _rows(context.moved_stopping_point(stops, moves), "project_id", "record_id") == [("p", "m1"), ("q", "r2"), ("s", "m3"), ("t", "m4")]


def test_coverage_and_notices(spark):
    tables = {
        "sources": spark.createDataFrame([("ready",), ("partial",), ("missing",)], "status string"),
        "records": spark.createDataFrame([(None, "x", "known", "codex"), (None, "", "naive", "codex"), ("p", "x", "missing", "project_document")],
                                         "project_id string, text string, time_status string, provider string"),
    }
    read = lambda covered: tuple(covered.first())
    assert read(resume.coverage(tables)) == (3, 2, 1, 1, "not_refreshed")
    runs = spark.createDataFrame([(1, "partial"), (2, "passed")], "run_id long, status string")
    covered = resume.coverage(tables | {"refresh_runs": runs})
    assert read(covered) == (3, 2, 1, 1, "passed")
    none = {name: df.filter("false") for name, df in (tables | {"refresh_runs": runs}).items()}
    assert read(resume.coverage(none)) == (0, 0, 0, 0, "not_refreshed")
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    trees = spark.createDataFrame([("w", "p", "i", "/w", False), ("v", "q", "i", "/v", True)], schema.WORKTREES)
    chosen = spark.createDataFrame([("p", 0), ("q", 3), ("q", 3)], "project_id string, omitted int")
    seen = lambda c: _rows(resume.notices(chosen, trees, projects, c), "project_id", "code", "amount")
    assert seen(covered) == [("p", "worktree_unavailable", 1), ("q", "items_omitted", 3)]
    assert [r[:2] for r in seen(resume.coverage(tables))] == [
        ("p", "coverage_incomplete"), ("p", "worktree_unavailable"), ("q", "coverage_incomplete"), ("q", "items_omitted")]


def test_foreign_observation_keeps_no_head(spark):
    """A worktree that was last seen as another repository has no head or branch in the resume."""
    kind = dict((f.name, f.dataType) for f in schema.fields(schema.OBSERVATIONS))["data"]
    seen = lambda common: F.struct(*[
        {"common_identity": F.lit(common), "head": F.lit("h"), "available": F.lit(True)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in kind.fields])
    one = lambda n, w, common: spark.range(1).select(
        F.lit(n).cast("long").alias("observation_id"), F.lit("p").alias("project_id"), F.lit(w).alias("worktree_id"),
        F.lit(T0).alias("observed_at"), seen(common).alias("data"))
    from worklore.operators import associate
    from worklore.plans import views

    projects = spark.createDataFrame([("p", "Probe", "c", "/c", T0)], schema.PROJECTS)
    trees = spark.createDataFrame([("w", "p", "i", "/w", True), ("v", "p", "i", "/v", True)], schema.WORKTREES)
    observed = associate.blank_foreign_observations(one(1, "w", "c").unionByName(one(2, "v", "other")), projects)
    records = spark.createDataFrame([], "project_id string")
    assert _rows(views.project_view(projects, trees, observed, records), "worktree_id", "head") == [("v", None), ("w", "h")]
