import pytest
from pyspark.sql import functions as F

from worklore.functions import textops, timeops
from worklore.operators import extract, prose

RECORD = "record_id string, provider string, actor string, kind string, full_text string, tool string"


def items(spark, rows):
    data = [
        (f"r{i}", "codex", actor, "user_intent" if actor == "user" else "agent_claim", text, None)
        for i, (actor, text) in enumerate(rows)
    ]
    out = extract.extract_items(spark.createDataFrame(data, RECORD)).orderBy(
        F.substring("record_id", 2, 9).cast("int"), "item_no"
    ).collect()
    return [(int(r.record_id[1:]), r.kind, r.status, r.category, r.text, r.target, r.priority, r.rationale, list(r.dependencies)) for r in out]


def test_markers_attributes_and_targets(spark):
    got = items(
        spark,
        [
            ("user", "GOAL: ship the probe"),
            ("user", "Görev: ölçümü yinele"),
            ("user", "SONRAKİ ADIM: bak"),
            ("assistant", "TASK: measure again"),
            ("assistant", "BLOCKER: no window"),
            ("user", "TASK: fix it | PRIORITY: high | REASON: it leaks | note\nDEPENDS_ON: a1, [b2]"),
            ("user", "CANCEL: [t-1], #t2, t_3 everything else"),
            ("user", "DONE: everything"),
            ("assistant", "DONE: the probe"),
            ("user", "PRINCIPLE: keep receipts"),
            ("user", "TASK: Critical: repair"),
        ],
    )
    by = {}
    for row in got:
        by.setdefault(row[0], []).append(row[1:])
    assert by[0] == [("objective", "active", "user_intent", "ship the probe", None, None, None, [])]
    assert by[1][0][:3] == ("task", "active", "user_intent")
    assert by[2][0][0] == "next_action"
    assert by[3][0][:3] == ("task", "proposed", "agent_proposal")
    assert by[4][0][:3] == ("blocker", "blocked", "agent_claim")
    assert by[5] == [("task", "active", "user_intent", "fix it | note", None, "high", "it leaks", ["a1", "b2"])]
    assert [(r[0], r[1], r[4]) for r in by[6]] == [("correction", "cancelled", t) for t in ("t-1", "t2", "t_3")]
    assert by[7][0][:3] == ("correction", "user_completed", "user_correction") and by[7][0][4] is None
    assert by[8][0][:3] == ("claim", "unverified", "agent_claim")
    assert by[9][0][:3] == ("principle", "proposed", "interpretation")
    assert by[10][0][5] == "critical"


def test_prose_ladder_and_leading_transitions(spark):
    got = items(
        spark,
        [
            ("user", "The export check is cancelled. The import check is completed. Run the probe."),
            ("user", "For instance, the check is pending."),
            ("user", "No pending work."),
            ("user", "If it fails, stop."),
            ("user", "That release is deferred."),
            ("user", "The probe is still waiting."),
            ("assistant", "All checks passed."),
            ("user", "please repeat the last prompt"),
            ("user", "Please inspect the log."),
            ("user", "Raporu iptal et."),
            ("assistant", "`done` is a word"),
        ],
    )
    by = {}
    for row in got:
        by.setdefault(row[0], []).append(row[1:])
    assert [(r[0], r[1], r[4]) for r in by[0]] == [
        ("correction", "cancelled", "text:check:export"),
        ("correction", "user_completed", "text:check:import"),
        ("next_action", "active", None),
    ]
    assert 1 not in by and 10 not in by
    assert by[2][0][:3] == ("context", "reported", "user_report")
    assert by[3][0][0] == "constraint"
    assert by[4][0][:2] == ("context", "deferred")
    assert by[5][0][:2] == ("blocker", "blocked")
    assert by[6][0][:3] == ("claim", "unverified", "agent_claim")
    assert by[7][0][0] == "conversation"
    assert by[8][0][:2] == ("next_action", "active")
    assert by[9][0][:2] == ("correction", "cancelled")


def test_inert_regions(spark):
    text = "\n".join(
        [
            "TASK: kept one", "```", "TASK: in fence", "~~~", "TASK: still in fence", "```", "> TASK: quoted",
            "TASK: lazy quote", "", "    TASK: indented", "- [x] TASK: checked", "- [ ] TASK: kept two",
            '"TASK: said"', "<!-- TASK: hidden", "TASK: hidden too -->", "1. TASK: kept three", "````", "TASK: unclosed", "```", "TASK: eaten",
        ]
    )
    df = spark.createDataFrame([("r", text)], "record_id string, full_text string")
    lines = [r.line for r in prose.prose_lines(df).orderBy("line_no").collect()]
    assert lines == ["TASK: kept one", "TASK: kept two", "TASK: kept three"]


def test_limit_and_tools(spark):
    many = "\n".join(f"TASK: item {i}" for i in range(257))
    data = [
        ("a", "codex", "user", "user_intent", many, None),
        ("b", "codex", "tool", "recorded_tool_result", " TASK: not a task ", None),
        ("c", "codex", "assistant", "agent_proposal", "ls", "terminal"),
        ("d", "codex", "system", "metadata", "TASK: no", None),
    ]
    found = extract.statements(spark.createDataFrame(data, RECORD)).cache()
    rows = {r.record_id: r for r in extract.number_items(found, most=256).collect()}
    assert set(rows) == {"b", "c"}
    assert (rows["b"].kind, rows["b"].status, rows["b"].text) == ("claim", "recorded", "TASK: not a task")
    assert (rows["c"].kind, rows["c"].status) == ("context", "proposed")
    assert [(r.record_id, r.statements) for r in extract.extraction_gaps(found).collect()] == [("a", 257)]


@pytest.mark.parametrize(
    "text, key",
    [
        ("Please verify the release signature.", "verify:release signature"),
        ("Verification of the export is pending", "verify:export"),
        ("the export check", "check:export"),
        ("imza bekliyor", "verify:signature"),
        ("Raporu kontrol et", "check:raporu"),
        ("Cancel the **old** [plan](x)", "old plan"),
    ],
)
def test_topic_key(spark, text, key):
    assert spark.range(1).select(textops.topic_key(F.lit(text))).first()[0] == key


def test_redaction_and_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(textops.redact(F.lit("a \x1b[31mred\x1b[0m password = hunter22, x"))) == "a red [REDACTED], x"
    assert one(textops.redact(F.lit("see https://u:pw@h/x sk-proj-abcdefgh1234"))) == "see [REDACTED]h/x [REDACTED]"
    long = one(textops.redact(F.lit("y" * 5000)))
    assert len(long) == 4096 - 14 + len(" …[truncated]") and long.endswith(" …[truncated]")
    times = {
        "2026-01-01T03:00:00+03:00": "known", "20260101T000000Z": "known", "2026-01-01T00:00:00": "naive",
        "2026-01-01": "naive", "soon": "invalid", "": "missing",
    }
    for value, status in times.items():
        assert one(timeops.time_status(F.lit(value))) == status, value
    assert one(timeops.iso_utc(timeops.event_time(F.lit("2026-01-01T03:00:00+03:00")))) == "2026-01-01T00:00:00.000000Z"
