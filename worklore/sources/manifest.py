"""Source listings and what changed since the last run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing, pathops


def build_manifest(spark: SparkSession, paths: Sequence[str], provider: str, glob: str = "*.jsonl*") -> DataFrame:
    """Path, length and time of each file; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(list(paths))
        .select("path", "length", "modificationTime")
    )
    path = F.coalesce(pathops.clean_absolute(F.col("path")), F.col("path"))
    return files.select(
        F.lit(provider).alias("provider"), path.alias("path"), "length",
        F.col("modificationTime").alias("modified_at"),
    )


def prefix_digests(lines: DataFrame, upto: DataFrame | None = None) -> DataFrame:
    """Digest of the first `line` lines per source, order-sensitive and mergeable.

    Each line contributes a hash of (number, text); the sums of independent hash
    words combine in any order, so no source is gathered into one task.
    """
    rows = lines.filter("not tail")
    if upto is not None:
        limits = upto.select(F.col("path").alias("_p"), F.col("line").alias("_line"))
        rows = rows.join(limits, F.col("source_path") == F.col("_p")).filter(F.col("line_no") <= F.col("_line"))
    digest = F.sha2(F.concat(F.col("line_no").cast("string"), F.lit(":"), F.col("value")), 256)
    word = lambda i: F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return (
        rows.select("source_path", "line_no", digest.alias("_d"))
        .groupBy("source_path")
        .agg(
            F.max("line_no").alias("line"),
            F.concat_ws("-", *[F.sum(word(i)).cast("string") for i in range(4)], F.count(F.lit(1)).cast("string")).alias("prefix_hash"),
        )
    )


def classify_sources(prior: DataFrame, listing: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """new, unchanged, appended, replaced, reread or missing for every source.

    `verified` (source_path, prefix_hash) holds the present digest of the prior
    prefix for sources that grew; without a match they are replaced.
    """
    old = prior.select(
        "source_id", F.col("provider").alias("_provider"), F.col("path").alias("_path"),
        F.col("length").alias("_length"), F.col("modified_at").alias("_modified"),
        F.col("status").alias("_status"), "generation", "line", "prefix_hash",
    )
    joined = listing.join(
        old, (listing.path == F.col("_path")) & (listing.provider == F.col("_provider")), "full_outer"
    )
    if verified is not None:
        joined = joined.join(
            verified.select(F.col("source_path").alias("_vp"), F.col("prefix_hash").alias("_vh")),
            F.col("path") == F.col("_vp"), "left",
        )
        intact = F.coalesce(F.col("_vh") == F.col("prefix_hash"), F.lit(False))
    else:
        intact = F.lit(False)
    same = (F.col("length") == F.col("_length")) & (F.col("modified_at") == F.col("_modified"))
    change = (
        F.when(F.col("path").isNull(), "missing")
        .when(F.col("_path").isNull(), "new")
        .when(F.col("_status").isin("missing", "excluded", "failed"), F.when(intact, "reread").otherwise("replaced"))
        .when(same, "unchanged")
        .when((F.col("length") >= F.col("_length")) & intact, "appended")
        .otherwise("replaced")
    )
    provider = F.coalesce("provider", "_provider")
    path = F.coalesce("path", "_path")
    return joined.withColumn("change", change).select(
        F.coalesce("source_id", hashing.content_id(provider, path)).alias("source_id"),
        provider.alias("provider"), path.alias("path"), "length", "modified_at",
        F.col("_status").alias("prior_status"), F.coalesce("generation", F.lit(0)).alias("prior_generation"),
        F.coalesce("line", F.lit(0)).cast("long").alias("prior_line"), "change",
    )


def next_generation(classified: DataFrame) -> DataFrame:
    """Replaced and new sources start the next generation; others keep theirs."""
    bump = F.col("change").isin("new", "replaced")
    number = F.when(bump, F.col("prior_generation") + 1).otherwise(F.col("prior_generation"))
    return classified.withColumns(
        {
            "generation": number.cast("int"),
            "from_line": F.when(F.col("change").isin("appended", "reread"), F.col("prior_line")).otherwise(F.lit(0)).cast("long"),
            "reads": F.col("change").isin("new", "replaced", "appended", "reread"),
        }
    )


def match_renames(classified: DataFrame, prior_prints: DataFrame, new_prints: DataFrame) -> DataFrame:
    """(old source_id, new path) where missing and new content match one to one."""
    lost = classified.filter("change = 'missing'").select("source_id", F.col("path").alias("old_path")).join(
        prior_prints.select(F.col("path").alias("old_path"), "fingerprint"), "old_path"
    )
    found = classified.filter("change = 'new'").select(F.col("path").alias("new_path")).join(
        new_prints.select(F.col("path").alias("new_path"), "fingerprint"), "new_path"
    )
    single_lost = lost.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("source_id", "old_path")).alias("l")
    ).filter("n = 1")
    single_found = found.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("m"), F.min("new_path").alias("new_path")
    ).filter("m = 1")
    return single_lost.join(single_found, "fingerprint").select(
        F.col("l.source_id").alias("source_id"), F.col("l.old_path").alias("old_path"), "new_path"
    )


def sweep_missing(prior: DataFrame, listing: DataFrame, exclusions: Sequence[str] = ()) -> DataFrame:
    """Known sources no longer listed: missing, or excluded by the present rules."""
    from .transcripts import allowed_path

    gone = prior.join(listing.select("provider", "path"), ["provider", "path"], "left_anti")
    return gone.withColumn(
        "status", F.when(~allowed_path(F.col("path"), exclusions), "excluded").otherwise("missing")
    )
