import pytest

import __spark_entry__ as entry_module


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["daily_actor_groups", "packed_documents", "context_carry", "appended_tails", "recorded_moves", "observed_metadata", "document_rungs", "briefing_facets"])
def test_query_agrees_with_check(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("events", "documents", "conversations"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = con.execute(f"select {', '.join(cols)} from ({entry_module.oracle_sql()[name]}) q").fetchall()
    assert got == sorted(tuple(str(v) for v in row) for row in want)


def _agrees(spark, name, sf="/root/testdata/sf0.01"):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = con.execute(f"select {', '.join(cols)} from ({entry_module.oracle_sql()[name]}) q").fetchall()
    return got == sorted(tuple(str(v) for v in row) for row in want)


@pytest.mark.parametrize("name,column,bound", [("long_records", "full_text", 3000), ("long_documents", "text", 12000)])
def test_long_texts_grow_in_number(spark, monkeypatch, name, column, bound):
    """Of ten thousand events no text has more lines than one block of events gives."""
    from worklore.operators import docs, extract

    seen, module, step = [], *((extract, "extract_items") if name == "long_records" else (docs, "section_records"))
    kept = getattr(module, step)
    monkeypatch.setattr(module, step, lambda rows, *rest: seen.append(rows) or kept(rows, *rest))
    assert _agrees(spark, name)
    lines = [r[column].count("\n") + 1 for r in seen[0].collect()]
    # Either half of the users, or one type, has so many events that the former caps would show.
    assert max(lines) <= bound and len(lines) > 5 - 3 * (name == "long_documents")
    assert max(lines) > (256 if name == "long_records" else 2 * 2048)


def test_scanned_files_grow_in_number(spark, monkeypatch):
    from worklore.sources import transcripts

    seen, read = [], transcripts.read_transcripts
    monkeypatch.setattr(transcripts, "read_transcripts", lambda *a, **k: seen.append(read(*a, **k)) or seen[-1])
    assert _agrees(spark, "scanned_transcripts", "/root/testdata/sf0.1")
    files = seen[0].select("source_path").distinct().count()
    assert files > 5
