"""Removal of passages that repeat across documents, by windows of three lines.

Built-in column functions only.  Lines without a word are kept and belong to no
window; the other lines of a text, in order, make overlapping windows of three.
A window's first occurrence, by (doc_id, text, place), stays; the lines of every
later occurrence are covered, and covered lines are removed, overlaps merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worklore import session
from worklore.functions.plans import settle
from worklore.llm.joins import sized

_WORD = r"[^\x20\x09-\x0D]"


def _with_lines(df: DataFrame, needed: Column) -> DataFrame:
    """lines: all lines; at: numbers (from 1) of those with a word, null where not needed.

    Both are settled, for a lambda would compute them again for every element.
    """
    df = settle(df.withColumn("lines", F.split("text", "\n")))
    worded = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(_WORD))
    return settle(df.withColumn("at", F.when(needed, worded)))


def _windows(keyed: DataFrame, size: int) -> DataFrame:
    """One row per window: its hash, the document, and its place among lines with words."""
    numbers = F.sequence(F.lit(1), F.size("at") - (size - 1))
    line = lambda i: F.element_at("lines", F.element_at("at", i))
    parts = lambda i: [*(line(i + k) for k in range(size)), *(F.octet_length(line(i + k)) for k in range(size))]
    # 128 bits: by 64 alone, some of very many windows would be equal by chance
    window = lambda i: F.struct(F.xxhash64(*parts(i)), F.xxhash64(F.lit("again"), *reversed(parts(i))))
    hashes = F.transform(numbers, window)
    return (
        _with_lines(keyed, F.col("text").isNotNull())
        .where(F.size("at") >= size)
        .select("doc_id", "text_hash", F.posexplode(hashes).alias("place", "window"))
    )


def later_occurrences(documents: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, places): windows of a document that occurred before.

    places are numbers, from 0, among the document's lines with words.
    """
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    windows = session.stage(_windows(keyed, size), "windows")
    first = windows.groupBy("window").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "place")).alias("first")
    )
    first = first.where("times > 1")
    later = windows.join(first, "window").where(F.struct("doc_id", "text_hash", "place") > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def _covered(size: int) -> Column:
    """Numbers of the lines in the windows at places, rising; at and places are columns."""
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.element_at("at", p + k)))))
    return F.array_sort(covered)


def drop_repeated_passages(documents: DataFrame, size: int = 3) -> DataFrame:
    """All rows of documents, in which text has lost the lines of later occurrences.

    Adds n_lines and n_removed.  A text of fewer than `size` lines with words has
    no window and stays as it is; null stays null.  A removed line goes with its
    line feed; a text may become empty.  Rows equal in doc_id and text are one
    document and stay equal.  Further columns are kept; columns named n_lines,
    n_removed, text_hash, places, lines, at or covered are replaced or dropped.
    """
    documents = documents.drop("n_lines", "n_removed", "text_hash", "places", "lines", "at", "covered")
    later = session.stage(later_occurrences(documents, size), "later")
    found = documents.withColumn("text_hash", F.xxhash64("text"))
    a, b = found.alias("a"), sized(later).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    joined = a.join(b, same, "left").select("a.*", "b.places")
    later_here = F.col("places").isNotNull()
    joined = settle(_with_lines(joined, later_here).withColumn("covered", F.when(later_here, _covered(size))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("covered", F.greatest(i, F.lit(1))))
    after = lambda i: F.when(i == F.size("covered"), F.size("lines") + 1).otherwise(F.element_at("covered", F.least(i + 1, F.size("covered"))))
    between = F.transform(
        F.sequence(F.lit(0), F.size("covered")), lambda i: F.slice("lines", before(i) + 1, after(i) - before(i) - 1)
    )
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in documents.columns),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).alias("n_removed"),
    )


def keep_fresh_lines(documents: DataFrame, size: int = 3) -> DataFrame:
    """`drop_repeated_passages` in the columns of documents, without texts that lost every word.

    n_chars, where there is one, follows a text that changed.
    """
    done = settle(drop_repeated_passages(documents, size))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(_WORD)
    kept = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in documents.columns:
        now = F.length("text").cast(dict(documents.dtypes)["n_chars"])
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, now).otherwise(F.col("n_chars")))
    return kept.select(documents.columns)
