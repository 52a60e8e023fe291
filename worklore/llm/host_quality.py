"""Quality rules judged per document and per host.

Every document gets counts and a base verdict.  Failures are summed by host, and
a host's failure rate is shrunk towards the rate that all hosts share: the rates
of hosts are taken as draws of a beta distribution, whose mean and spread come
from the hosts themselves, and a host's rate is its posterior mean.  Hosts whose
rate is above a limit are refused with all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from worklore import session
from worklore.llm import textscan
from worklore.llm.joins import sized

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def rule_counts(texts: pa.Array, n: int = 5) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every text; null is empty."""
    w = textscan.words(texts)
    docs = w.n_docs
    n_words = np.bincount(w.doc, minlength=docs)
    inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.bounds])
    chars = (w.data & 0xC0) != 0x80
    marks = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(marks, w.starts, 1)
    np.add.at(marks, w.ends, -1)
    word_chars = inside(chars & (np.cumsum(marks[:-1]) > 0))

    run = textscan.runs(w.hashes(), n)
    at = np.flatnonzero(w.doc[: len(run)] == w.doc[len(w.doc) - len(run) :])
    twice = at[_repeated(w.doc[at], run[at])[0]]
    cover = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    covered = w.doc[np.cumsum(cover[:-1]) > 0]

    feeds = np.flatnonzero(w.data == 10)
    filled = w.bounds[:-1][np.diff(w.bounds) > 0]
    starts = np.union1d(filled, feeds[~np.isin(feeds + 1, w.bounds)] + 1)
    owner = np.searchsorted(w.bounds, starts, "right") - 1
    stops = np.minimum(np.append(starts[1:], len(w.data)), w.bounds[owner + 1])
    stops = stops - ((stops > starts) & (w.data[np.maximum(stops - 1, 0)] == 10)) if len(starts) else stops
    first_word = np.searchsorted(w.starts, starts)
    worded = first_word < np.searchsorted(w.starts, stops)
    starts, stops, owner = starts[worded], stops[worded], owner[worded]
    again = _repeated(owner, textscan.span_hashes(w.data, starts, stops))[1] if len(starts) else np.zeros(0, bool)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": inside(_SYMBOL[w.data]),
        "n_dup_lines": np.bincount(owner[again], minlength=docs),
        "n_repeat_words": np.bincount(covered, minlength=docs),
    }


def _repeated(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (owner, value) occur more than once, and which occurred before."""
    by = np.lexsort((np.arange(len(owner)), value, owner))
    same = (owner[by][1:] == owner[by][:-1]) & (value[by][1:] == value[by][:-1])
    some, again = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    some[by[1:][same]] = some[by[:-1][same]] = again[by[1:][same]] = True
    return some, again


def document_counts(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and COUNTS of every row."""
    columns = list(keep)
    frame = documents.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name in columns)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def counted(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.batches(arriving, "text"):
            counts = rule_counts(batch.column("text"))
            arrays = [batch.column(c) for c in columns] + [pa.array(counts[c].astype(np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *names])

    return frame.mapInArrow(counted, f"{kinds}, {COUNTS}")


def host_rates(failures: DataFrame) -> DataFrame:
    """Adds rate to (host, n, failed): each host's failure rate, shrunk to the common one.

    mean: of all documents.  strength: the documents' worth of prior that the
    spread of the hosts' rates leaves after what chance alone spreads them; with
    one host or no spread beyond chance it is large and all rates are the mean.
    """
    total = failures.agg(F.sum("n").alias("n"), F.sum("failed").alias("bad"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    if not total["n"]:
        return failures.withColumn("rate", F.lit(None).cast("double"))
    mean = total["bad"] / total["n"]
    own = F.col("failed") / F.col("n")
    apart = failures.agg(F.sum(F.col("n") * F.pow(own - mean, 2))).first()[0]
    chance, freedom = mean * (1 - mean), total["n"] - total["squares"] / total["n"]
    beyond = (apart - (total["hosts"] - 1) * chance) / freedom if total["hosts"] > 1 else 0.0
    strength = max(chance / beyond - 1, 1.0) if beyond > 1e-12 else 1e9
    return failures.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def _judged(documents: DataFrame, host: str, most: float) -> DataFrame:
    """doc_id, text_hash, COUNTS, base_failed and kept of every row."""
    keyed = documents.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = document_counts(keyed, "doc_id", "host", "text_hash").withColumn("base_failed", failed)
    rows = session.stage(rows, "quality")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    refused = host_rates(hosts).select(F.col("host").alias("judged"), (F.col("rate") > most).alias("refused"))
    joined = rows.join(refused, F.col("host").eqNullSafe(F.col("judged")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("refused")).drop("host", "judged", "refused")


def judge(documents: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated
    five-word windows.  kept: not base_failed, and the host's shrunk failure
    rate at most `most`.  A null host is a host of its own.  Repeated rows count
    as often as they occur.  The counts are staged, so texts are read once.
    """
    return _judged(documents, host, most).drop("text_hash")


def keep_good(documents: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """The rows of documents that `judge` keeps, whole."""
    gone = _judged(documents, host, most).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    a, b = documents.withColumn("_hash", F.xxhash64("text")).alias("a"), sized(session.stage(gone, "refused")).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._hash") == F.col("b.text_hash"))
    return a.join(b, same, "left_anti").drop("_hash")
