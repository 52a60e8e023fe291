"""JSON-lines transcript scans with exact line numbers and byte offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import jsonops as J, ordering, pathops, patterns as P


def _pin_splits(spark: SparkSession) -> None:
    """Keep file splits equal across the scans of one plan while executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def allowed_path(path: Column, exclusions: Sequence[str] = ()) -> Column:
    """Not below a generated, secret or excluded location."""
    parts = F.split(path, "/")
    hidden = F.exists(
        parts,
        lambda p: p.isin(P.GENERATED_DIRECTORIES + P.SENSITIVE_NAMES) | p.startswith(".env"),
    )
    keep = ~hidden
    for pattern in exclusions:
        regex = pathops.file_glob(pattern)
        keep = keep & ~path.rlike(regex) & ~pathops.base_name(path).rlike(regex)
    return keep


def read_transcripts(
    spark: SparkSession,
    paths: str | Sequence[str],
    compressed: bool = False,
    exclusions: Sequence[str] = (),
    glob: str | None = None,
) -> DataFrame:
    """One row per line: source_path, block, line_no, byte_offset, value, locator, tail.

    `tail` marks a last line without its newline.  Numbers come from per-block
    counts, so a file split over many tasks is never gathered into one.
    """
    _pin_splits(spark)
    suffix = glob or ("*.jsonl.zst" if compressed else "*.jsonl")
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix)
        .option("lineSep", "\n")
        .text([paths] if isinstance(paths, str) else list(paths))
    )
    return place_lines(raw, compressed, exclusions)


def place_lines(raw: DataFrame, compressed: bool = False, exclusions: Sequence[str] = ()) -> DataFrame:
    """Number the lines of a text scan (also of one micro-batch of whole files)."""
    raw = raw.select(
        F.coalesce(
            pathops.clean_absolute(F.col("_metadata.file_path")), F.col("_metadata.file_path")
        ).alias("source_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    raw = raw.filter(allowed_path(F.col("source_path"), exclusions))
    numbered = ordering.number_rows(
        raw, ["source_path"], "block", "_seq", "line_no",
        weight=F.octet_length("value") + F.lit(1), offset="byte_offset",
    )
    if compressed:
        locator = F.concat(F.lit("decompressed-line:"), F.col("line_no").cast("string"))
        tail = F.lit(False)
    else:
        locator = F.concat(
            F.lit("line:"), F.col("line_no").cast("string"),
            F.lit("@"), F.col("byte_offset").cast("string"),
        )
        tail = F.col("byte_offset") + F.octet_length("value") >= F.col("_size")
    return numbered.select(
        "source_path", "block", "line_no", "byte_offset", "value",
        locator.alias("locator"), tail.alias("tail"),
    )


def parse_lines(lines: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Add `body` (VARIANT of a JSON object) or the `code` of the gap; drop blank lines.

    most_bytes: longer lines are gaps; by default there is no limit.
    """
    oversized = F.lit(False) if most_bytes is None else F.octet_length("value") + F.lit(1) > most_bytes
    gap = (
        F.when(F.col("tail") & oversized, "oversized_incomplete_tail")
        .when(F.col("tail"), "incomplete_tail")
        .when(oversized, "record_size_limit")
    )
    body = F.when(gap.isNull(), J.parse(F.col("value")))
    parsed = lines.filter(F.col("value").rlike(r"\S")).select(
        "source_path", "block", "line_no", "locator", gap.alias("_gap"), body.alias("body")
    )
    code = F.coalesce(
        F.col("_gap"), F.when(~J.is_object(F.col("body")), F.lit("malformed_record"))
    )
    return parsed.withColumn("code", code).drop("_gap")
