import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from worklore.llm.shipping import ship

    ship(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(60_000))
    passage = "one two three four five six\nseven eight nine ten eleven\ntwelve thirteen fourteen"
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "a", 5: "it's a <|endoftext|> test", 6: long, 7: long, 8: passage,
        9: "first own line here\n" + passage + "\nlast own line here", 10: passage, 11: "x " * 40, 12: "Straße Σίσυφος 日本語 e\u0301 \u00a0",
        13: "same same same\nsame same same\n\nsame same same", 14: "\n".join(["rep eat"] * 9), 15: "'ll 'S don't", 16: "ends with feed\n",
    }
    for n, step in enumerate((10, 11, 12)):  # regular words that power sums cannot tell apart
        turns = [bin(i).count("1") % 2 for i in range(1 << step)]
        texts[20 + n] = "".join("ab"[x] for x in turns) + "\n" + "".join("ba"[x] for x in turns)
        texts[30 + n] = "".join("-="[x] for x in turns)
        texts[40 + n] = "".join("=-"[x] for x in turns)
    rows = [(i, t, "en", "s" if i % 2 else None, None) for i, t in texts.items()]
    return [*rows, rows[7], rows[4], (None, "no id here", None, "s", 3), (8, "other text under a used id", "en", "s", 1)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()
