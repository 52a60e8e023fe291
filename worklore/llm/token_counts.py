"""Token counts through a cache keyed by content and tokenizer digests.

Texts are known by the SHA-256 of their bytes, a tokenizer by the digest of its
file and the library's version.  One representative of every digest that the
cache lacks is encoded; the new counts are appended to the cache; then every
document takes its count from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from worklore.llm import wordcodes
from worklore.llm.textscan import batches

CACHE = "version binary, digest binary, n_tokens long"


def tokenizer_version(path: str) -> bytes:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).digest()


def read_cache(spark: SparkSession, folder: str, version: bytes) -> DataFrame:
    """Counts of one tokenizer version; appends that overlapped are folded."""
    try:
        rows = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    rows = rows.where(F.col("version") == F.lit(version))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    df: DataFrame, tokenizer: str, cache: str, limit: int = 1024, direct_rows: int = 500_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; null texts are empty.

    cache: folder of the count table, shared by all executors, made if absent.
    direct_rows: up to so many missing digests are sent to the text scan; more
    are joined by shuffling.  Repeated rows share a representative and stay repeated.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = df.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text")
    )
    missing = (
        keyed.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(read_cache(spark, cache, version), "digest", "left_anti")
    )
    if missing.limit(direct_rows + 1).count() <= direct_rows:
        missing = F.broadcast(missing)
    a, b = keyed.alias("a"), missing.alias("b")
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    texts = a.join(b, same, "left_semi").select("digest", "text")

    def counted(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, met = wordcodes.encoder(tokenizer), set()
        for batch in batches(arriving, "text"):
            fresh = []
            for digest in batch.column("digest").to_pylist():
                fresh.append(digest not in met)
                met.add(digest)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            _, offsets = e.encode(batch.column("text").to_pylist())
            versions = pa.array([version] * batch.num_rows, pa.binary())
            counts = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([versions, batch.column("digest"), counts], ["version", "digest", "n_tokens"])

    counts = texts.mapInArrow(counted, CACHE).dropDuplicates(["version", "digest"])
    counts.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    return keyed.drop("text").join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
