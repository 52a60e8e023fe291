"""Connected components of a link table, without bringing links together anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from worklore import session


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node it reaches.

    Each round takes the least root among a node's neighbours, then the root of
    that root, so distances shrink by halves.  Rounds are written to the shared
    folder.  No links give no rows.
    """
    both = links.union(links.select("b", "a")).distinct()
    edges = session.stage(both, "links")
    roots = session.stage(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        beside = edges.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(beside, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        lower = session.stage(lower, "roots")
        upper = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = lower.join(upper, "root").select("node", F.least("root", "further").alias("root"), "was")
        jumped = session.stage(jumped, "roots")
        roots = jumped.drop("was")
        if not jumped.where(F.col("root") != F.col("was")).limit(1).count():
            return roots
