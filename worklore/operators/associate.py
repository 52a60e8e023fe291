"""Attribution of records to projects and worktrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing, pathops, patterns as P


def directory_mapping(cwds: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Each distinct working directory -> deepest registered enclosing worktree.

    Directories are exploded into their ancestors and equi-joined on path, which
    replaces a prefix comparison against every worktree.
    """
    distinct = cwds.select("cwd").filter("cwd is not null").distinct().withColumn(
        "_path", pathops.clean_absolute(F.col("cwd"))
    )
    trees = worktrees.select(
        F.col("path").alias("_tree"), "project_id", "worktree_id",
    )
    hits = (
        distinct.select("cwd", F.explode_outer(pathops.ancestors(F.col("_path"))).alias("_ancestor"))
        .join(trees, F.col("_ancestor") == F.col("_tree"))
        .groupBy("cwd")
        .agg(
            F.max_by(
                F.struct("project_id", "worktree_id"),
                F.struct(pathops.depth(F.col("_tree")), F.col("worktree_id")),
            ).alias("_hit")
        )
        .select(F.col("cwd").alias("_cwd"), "_hit")
    )
    cwd, hit = F.col("cwd"), F.col("_hit")
    reason = (
        F.when(cwd == "", "missing_working_context")
        .when(F.col("_path").isNull() & cwd.startswith("file:"), "invalid_local_working_context")
        .when(~cwd.startswith("/") & ~cwd.startswith("file:"), "relative_working_context")
        .when(hit.isNotNull(), P.REGISTERED_REASON)
        .otherwise("unregistered_working_context")
    )
    return distinct.join(hits, F.col("cwd") == F.col("_cwd"), "left").select(
        "cwd", "_hit.project_id", "_hit.worktree_id", reason.alias("association_reason")
    )


def latest_mappings(associations: DataFrame) -> DataFrame:
    return associations.groupBy("target").agg(
        F.max(
            F.struct("created_at", "association_id", "project_id", "worktree_id")
        ).alias("_map")
    )


def associate(records: DataFrame, worktrees: DataFrame, associations: DataFrame | None = None) -> DataFrame:
    """Add project_id, worktree_id, association_reason; explicit mappings win."""
    mapping = directory_mapping(records, worktrees).select(
        F.col("cwd").alias("_cwd"), F.col("project_id").alias("_p"),
        F.col("worktree_id").alias("_w"), F.col("association_reason").alias("_why"),
    )
    base = records.drop("project_id", "worktree_id", "association_reason")
    joined = base.join(mapping, F.col("cwd") == F.col("_cwd"), "left")
    if associations is None:
        return joined.withColumns(
            {
                "project_id": F.col("_p"), "worktree_id": F.col("_w"),
                "association_reason": F.coalesce("_why", F.lit("missing_working_context")),
            }
        ).drop("_cwd", "_p", "_w", "_why")
    latest = latest_mappings(associations)
    by_record = latest.select(F.col("target").alias("_rt"), F.col("_map").alias("_rm"))
    by_session = latest.select(F.col("target").alias("_st"), F.col("_map").alias("_sm"))
    explicit = F.greatest(F.col("_rm"), F.col("_sm"))
    return (
        joined.join(by_record, F.col("record_id") == F.col("_rt"), "left")
        .join(by_session, F.col("session_id") == F.col("_st"), "left")
        .withColumn("_e", explicit)
        .withColumns(
            {
                "project_id": F.when(F.col("_e").isNotNull(), F.col("_e.project_id")).otherwise(F.col("_p")),
                "worktree_id": F.when(F.col("_e").isNotNull(), F.col("_e.worktree_id")).otherwise(F.col("_w")),
                "association_reason": F.when(F.col("_e").isNotNull(), P.EXPLICIT_REASON)
                .otherwise(F.coalesce("_why", F.lit("missing_working_context"))),
            }
        )
        .drop("_cwd", "_p", "_w", "_why", "_rt", "_rm", "_st", "_sm", "_e")
    )


def reassociate(records: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Retry records without a project; settled and explicit ones stay."""
    open_ = F.col("project_id").isNull() & (
        F.coalesce("association_reason", F.lit("")) != P.EXPLICIT_REASON
    )
    retried = associate(records.filter(open_), worktrees)
    return records.filter(~open_).unionByName(retried)


def find_project(projects: DataFrame, worktrees: DataFrame, value: str) -> str:
    """Id of the one project with this id, name or worktree path."""
    by_path = worktrees.filter(F.col("path") == value).select("project_id")
    found = (
        projects.filter((F.col("project_id") == value) | (F.col("name") == value))
        .select("project_id").unionByName(by_path).distinct().limit(2).collect()
    )
    if len(found) != 1:
        raise ValueError("project_not_found" if not found else "ambiguous_project_name_use_id")
    return found[0]["project_id"]


def find_worktree(worktrees: DataFrame, value: str, project_id: str | None = None) -> str:
    match = (F.col("worktree_id") == value) | (F.col("path") == value)
    rows = worktrees.filter(match)
    if project_id:
        rows = rows.filter(F.col("project_id") == project_id)
    found = rows.select("worktree_id").limit(2).collect()
    if len(found) != 1:
        raise ValueError("worktree_not_found_or_wrong_project")
    return found[0]["worktree_id"]


def upsert_worktrees(worktrees: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match observations to worktrees by identity, else by (project, path), else new.

    Returns the worktrees after the update and the observations with their id.
    """
    identity = F.col("data.worktree_identity")
    by_identity = worktrees.filter("identity is not null").groupBy(
        F.col("identity").alias("_identity")
    ).agg(F.min("worktree_id").alias("_by_identity"))
    by_path = worktrees.groupBy(
        F.col("project_id").alias("_project"), F.col("path").alias("_path")
    ).agg(F.min("worktree_id").alias("_by_path"))
    matched = (
        observations.join(by_identity, identity == F.col("_identity"), "left")
        .join(
            by_path,
            (F.col("project_id") == F.col("_project")) & (F.col("data.path") == F.col("_path")),
            "left",
        )
        .withColumn(
            "worktree_id",
            F.coalesce(
                "_by_identity", "_by_path",
                hashing.content_id(
                    F.lit("worktree"), F.col("project_id"), F.coalesce(identity, F.col("data.path"))
                ),
            ),
        )
        .drop("_identity", "_by_identity", "_project", "_path", "_by_path")
    )
    newest = matched.groupBy("worktree_id").agg(
        F.max_by(
            F.struct(
                "project_id", identity.alias("identity"), F.col("data.path").alias("path"),
                F.col("data.available").alias("active"),
            ),
            F.struct("observed_at", "observation_id"),
        ).alias("_new")
    ).select(F.col("worktree_id").alias("_wid"), "_new")
    merged = worktrees.join(newest, worktrees.worktree_id == F.col("_wid"), "full_outer").select(
        F.coalesce("worktree_id", "_wid").alias("worktree_id"),
        F.coalesce("project_id", "_new.project_id").alias("project_id"),
        F.coalesce("identity", "_new.identity").alias("identity"),
        F.coalesce("_new.path", "path").alias("path"),
        F.coalesce("_new.active", "active").alias("active"),
    )
    return merged, matched


def blank_foreign_observations(observations: DataFrame, projects: DataFrame) -> DataFrame:
    """An observation of another repository at the path keeps no repository facts."""
    known = projects.select(
        F.col("project_id").alias("_pid"), F.col("common_identity").alias("_common")
    )
    d = F.col("data")
    foreign = d["available"] & ~d["common_identity"].eqNullSafe(F.col("_common"))
    null = F.lit(None).cast("string")
    blanked = (
        d.withField("available", F.lit(False))
        .withField("head", null).withField("branch", null)
        .withField("common_identity", null).withField("worktree_identity", null)
        .withField("status", F.slice(d["status"], 1, 0))
        .withField("commits", F.slice(d["commits"], 1, 0))
        .withField(
            "diagnostics",
            F.array_append(
                F.coalesce(d["diagnostics"], F.array().cast("array<string>")),
                F.lit("repository_identity_changed_at_path"),
            ),
        )
    )
    return (
        observations.join(known, F.col("project_id") == F.col("_pid"), "left")
        .withColumn("data", F.when(foreign, blanked).otherwise(d))
        .drop("_pid", "_common")
    )
