"""Project documents as files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import hashing, pathops, patterns as P
from .ranges import open_file
from .transcripts import allowed_path


def default_selected(relative: Column) -> Column:
    """Status documents at the root or below docs/."""
    parts = F.split(relative, "/")
    stem = F.regexp_replace(pathops.base_name(relative), r"\.[^.]*$", "")
    placed = (F.size(parts) == 1) | (F.lower(F.get(parts, F.lit(0))) == "docs")
    return placed & stem.rlike(P.ci(P.DOCUMENT_NAME))


def is_private(relative: Column) -> Column:
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(
        folders,
        lambda p: p.startswith(".")
        | F.lower(p).isin(P.PRIVATE_DIRECTORIES + P.GENERATED_DIRECTORIES + P.SENSITIVE_NAMES),
    )
    name = F.lower(pathops.base_name(relative))
    return (
        hidden | name.rlike(r"^(?:\.|credentials|secrets)") | name.isin(P.SENSITIVE_NAMES)
        | name.rlike(r"\.(?:pem|key)$")
    )


def with_content(listed: DataFrame) -> DataFrame:
    """Adds content (binary) and `unreadable` to a listing (path, ...): only the files of its rows are opened."""

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for at, path in enumerate(batch.column("path").to_pylist()):
                content, failed = None, False
                try:
                    with open_file(path) as f:
                        content = f.read()
                except OSError:
                    failed = True
                row = batch.slice(at, 1)
                yield row.append_column("content", pa.array([content], pa.binary())).append_column("unreadable", pa.array([failed]))

    kinds = ", ".join(f"`{n}` {t}" for n, t in listed.dtypes)
    # Dealt into a fixed number of tasks: one small row stands for a whole file, and by the size of
    # its rows the listing of very many files would be taken for a single task.
    spark = listed.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(tasks, "path").mapInArrow(run, f"{kinds}, content binary, unreadable boolean")


def read_documents(
    spark: SparkSession,
    root: str,
    project_id: str,
    worktree_id: str,
    patterns: Sequence[str] | None = None,
    max_bytes: int | None = None,
    max_depth: int | None = None,
    exclusions: Sequence[str] = (),
) -> DataFrame:
    """Selected documents of one worktree; `code` names why one was rejected.

    Files are listed and selected by path and length first; only those selected are opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*").load(root).select("path", "length", "modificationTime")
    )
    path = F.coalesce(pathops.clean_absolute(F.col("path")), F.col("path"))
    relative = F.substr(F.col("_path"), F.lit(len(root.rstrip("/")) + 2))
    listed = files.withColumn("_path", path).withColumn("relative_path", relative)
    if patterns is None:
        selected = default_selected(F.col("relative_path"))
    else:
        selected = F.lit(False)
        for pattern in patterns:
            selected = selected | F.col("relative_path").rlike(pathops.segment_glob(pattern))
    rel = F.col("relative_path")
    chosen = listed.filter(selected & ~is_private(rel) & allowed_path(rel, exclusions))
    if max_depth is not None:
        chosen = chosen.filter(F.size(F.split(rel, "/")) <= max_depth + 1)
    suffix = F.lower(F.regexp_extract(pathops.base_name(rel), r"\.([^.]+)$", 1))
    too_long = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    wrong_kind = ~suffix.isin(P.DOCUMENT_SUFFIXES) & (F.lower(pathops.base_name(rel)) != "readme")
    early = F.when(wrong_kind, "document_unsupported_format").when(too_long, "document_byte_limit")
    judged = chosen.withColumn("_early", early)
    unopened = judged.filter("_early is not null").withColumns({"content": F.lit(None).cast("binary"), "unreadable": F.lit(False)})
    chosen = with_content(judged.filter("_early is null")).unionByName(unopened)
    content = F.col("content")
    text = F.try_validate_utf8(F.regexp_replace(content.cast("string"), "^\ufeff", ""))
    code = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("unreadable"), "document_unreadable")
        .when(F.contains(content, F.lit(b"\x00")), "document_binary_unsupported")
        .when(text.isNull(), "document_encoding_unsupported")
    )
    return chosen.select(
        hashing.content_id(F.lit(P.PROVIDER_DOCUMENT), F.lit(worktree_id), rel).alias("document_id"),
        F.lit(project_id).alias("project_id"), F.lit(worktree_id).alias("worktree_id"),
        F.lit(root.rstrip("/")).alias("root_path"), "relative_path", "length", "modificationTime",
        F.sha2(content, 256).alias("fingerprint"), "content", text.alias("text"), code.alias("code"),
    ).withColumns(
        {
            "text": F.when(F.col("code").isNull(), F.col("text")),
            "content": F.when(F.col("code").isNull(), F.col("content")),
        }
    )

