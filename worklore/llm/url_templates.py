"""Verdicts on urls from a tree of path templates per host.

Segment by segment, from the host down, a branch whose next segments vary (many
different ones, or nearly one for every page) goes on as one wildcard; segments
with labels enough of their own keep their names, as do all others.  From the leaves up, sibling branches whose labelled
rates do not differ by more than chance are merged into one branch.
A template whose share of good labels, smoothed by its siblings', is low is refused.
Listed rules come before templates.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklore import session

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, rule) pairs, and its verdict; null without one.

    A rule is a host and a path; it fits that host and its subdomains when the
    url's path starts with the rule's.  Of equally long rules the first by name wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, tail = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shared(low: Column, high: Column) -> Column:
    """How many first segments two arrays have in common."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(low), F.size(high)))


def _generalised(paths: DataFrame, depth: int | None, children: int, least: int, own: int) -> DataFrame:
    """Adds template (array of segments) to rows (host, path, n, good, labelled).

    A round takes every branch to its next fork, over all segments that its paths
    share (the least and the greatest path of a branch show them), and passes that
    fork.  So a path that is alone in its branch is done at once, and rounds follow
    the forks on a path, not its length.  Finished rows go to one folder.
    """
    spark = paths.sparkSession
    whole = F.split("path", "/")
    segments = whole if depth is None else F.slice(whole, 1, depth)
    rows = paths.withColumns({"segments": segments, "template": F.array().cast("array<string>")})
    done = f"{session.shared_dir(spark)}/finished-{uuid.uuid4().hex}"
    schema = rows.drop("segments").schema
    while True:
        rest = F.slice("segments", F.size("template") + 1, F.size("segments"))
        ends = rows.groupBy("host", "template").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
        # One next segment only is never varied, unless these parameters say so.
        shared = _shared(F.col("low"), F.col("high")) if children >= 1 and least >= 2 else F.lit(0)
        ends = ends.select("host", "template", shared.alias("shared"))
        gone = F.slice("segments", 1, F.size("template") + F.col("shared"))
        literal = F.slice(gone, F.size("template") + 1, F.col("shared"))
        rows = rows.join(ends, ["host", "template"]).withColumn("template", F.concat("template", literal)).drop("shared")
        rows = session.stage(rows, "forks")
        at_end = F.size("segments") <= F.size("template")
        rows.where(at_end).drop("segments").write.mode("append").parquet(done)
        rows = rows.where(~at_end).withColumn("next", F.get("segments", F.size("template")))
        named = rows.groupBy("host", "template", "next").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"))
        nodes = named.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
        varied = (F.col("kinds") > children) | ((F.col("pages") >= least) & (2 * F.col("kinds") > F.col("pages")))
        nodes = nodes.select("host", "template", varied.alias("varied"))
        kept = named.where(F.col("labelled") >= own).select("host", "template", "next", F.lit(True).alias("kept"))
        step = F.when(F.col("varied") & F.col("kept").isNull(), F.lit("*")).otherwise(F.col("next"))
        rows = rows.join(nodes, ["host", "template"]).join(kept, ["host", "template", "next"], "left")
        rows = rows.withColumn("template", F.concat("template", F.array(step)))
        rows = session.stage(rows.drop("next", "varied", "kept"), "templates")
        if rows.isEmpty():
            break
    rows = spark.read.schema(schema).parquet(done)
    if depth is not None:
        longer = F.concat("template", F.array(F.lit("**")))
        rows = rows.withColumn("template", F.when(F.size(whole) > depth, longer).otherwise(F.col("template")))
    return rows


def _next_level(rows: DataFrame, above: int | None) -> int | None:
    """The deepest level below `above` at which two branches differ and all their other segments agree.

    The others are compared by hash; a chance hit costs a round that merges nothing.
    """
    marks = F.transform("merged", lambda x, i: F.xxhash64(i, x))
    total = F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias("total")
    places = rows.select("host", F.size("merged").alias("length"), total, F.posexplode("merged").alias("place", "segment"))
    if above is not None:
        places = places.where(F.col("place") < above)
    others = F.col("total").bitwiseXOR(F.xxhash64("place", "segment")).alias("others")
    groups = places.groupBy("host", "length", "place", others).agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    return groups.where("low <> high").agg(F.max("place")).first()[0]


def _merged(leaves: DataFrame, z: float, shown: int) -> DataFrame:
    """(host, template, merged): branches after merging siblings alike in their labels.

    At each level, from the deepest up, siblings (equal in host and all other
    segments) are sorted by their share of good labels and cut where neighbours
    differ by more than z standard errors; what lies between two cuts becomes one
    branch, named by its segments (the first `shown` and the number of others: a
    segment is in one branch only).  A branch without labels stays by itself.
    Only levels at which labelled siblings differ take a round.
    """
    marked = leaves.where("labelled > 0").select("host", "template", "good", "labelled")
    rows = session.stage(marked.withColumn("merged", F.col("template")), "branches")
    siblings = Window.partitionBy("host", "masked").orderBy("share", "segment")
    level = None
    while (level := _next_level(rows, level)) is not None:
        masked = F.transform("merged", lambda x, i: F.when(i == level, F.lit("")).otherwise(x))
        rows = rows.withColumns({"masked": masked, "segment": F.get("merged", F.lit(level))})
        own = rows.groupBy("host", "masked", "segment").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
        own = own.where("labelled > 0 and segment is not null").withColumn("share", F.col("good") / F.col("labelled"))
        before = {c: F.lag(c).over(siblings) for c in ("good", "labelled", "share")}
        pool = (F.col("good") + before["good"]) / (F.col("labelled") + before["labelled"])
        error = F.sqrt(pool * (1 - pool) * (1 / F.col("labelled") + 1 / before["labelled"]))
        cut = F.coalesce((F.col("share") - before["share"] > z * error).cast("int"), F.lit(0))
        groups = own.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(siblings))
        groups = groups.select("host", "masked", "segment", "cluster")
        alike = groups.groupBy("host", "masked", "cluster").agg(F.array_sort(F.collect_set("segment")).alias("all"))
        others = F.when(F.size("all") > shown, F.concat(F.lit("|+"), F.size("all") - shown)).otherwise("")
        name = F.concat(F.array_join(F.slice("all", 1, shown), "|"), others).alias("name")
        names = groups.join(alike.select("host", "masked", "cluster", name), ["host", "masked", "cluster"])
        rows = rows.join(names.select("host", "masked", "segment", "name"), ["host", "masked", "segment"], "left")
        named = F.transform("merged", lambda x, i: F.when((i == level) & F.col("name").isNotNull(), F.col("name")).otherwise(x))
        rows = session.stage(rows.withColumn("merged", named).drop("name", "masked", "segment"), "branches")
    renamed = rows.select("host", "template", F.col("merged").alias("into"))
    return leaves.join(renamed, ["host", "template"], "left").withColumn("merged", F.coalesce("into", "template")).drop("into")


def _judged(stats: DataFrame, prior: float, weight: float) -> DataFrame:
    """(host, merged, purity): a branch's share of good labels, smoothed by that of its siblings.

    Siblings (all branches one segment up) are smoothed by their host's share, and
    a host's by the overall one, each with the same weight.
    """
    sums = [F.sum("good").alias("good"), F.sum("labelled").alias("labelled")]
    smoothed = lambda base: (F.col("good") + weight * base) / (F.col("labelled") + weight)
    above = F.slice("merged", 1, F.size("merged") - 1)
    branches = stats.groupBy("host", "merged").agg(*sums).withColumn("above", above)
    parents = branches.groupBy("host", "above").agg(*sums)
    hosts = parents.groupBy("host").agg(*sums).select("host", smoothed(F.lit(prior)).alias("base"))
    parents = parents.join(hosts, "host").select("host", "above", smoothed(F.col("base")).alias("base"))
    return branches.join(parents, ["host", "above"]).select("host", "merged", smoothed(F.col("base")).alias("purity"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    depth: int | None = None,
    children: int = 20,
    least: int = 10,
    own: int = 5,
    z: float = 1.96,
    weight: float = 4.0,
    purity: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    labels: (page_id, good) for some pages.  children, least: more than `children`
    next segments, or from `least` pages on over half as many as pages, vary.
    own: labels that keep a segment's name where segments vary.  depth: where
    given, segments told apart; longer paths share the rest as one wildcard.
    weight: labels' worth of the siblings' share that smooths every template's, of the
    host's that smooths the siblings', and of the overall one that smooths the host's.
    A null url has an empty host and path.  Repeated pages stay repeated, and
    count as often; several labels of a page all count.  Without any labels
    nothing is refused.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = matching_rule(rules, F.col("host"), F.col("path"))
    marks = labels.groupBy("page_id").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.count("good").alias("labelled")
    )
    known = parsed.join(marks, "page_id", "left")
    paths = session.stage(
        known.groupBy("host", "path").agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
        ),
        "paths",
    )
    templates = session.stage(_generalised(paths, depth, children, least, own), "templates")
    leaves = templates.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    leaves = session.stage(leaves, "leaves")
    stats = session.stage(_merged(leaves, z, children), "merged")
    total = leaves.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    prior = (total["g"] / total["l"]) if total["l"] else 1.0
    judged = _judged(stats, prior, weight)
    by_leaf = stats.join(judged, ["host", "merged"]).select(
        "host", "template", F.array_join("merged", "/").alias("shown"), "purity"
    )
    by_path = templates.select("host", "path", "template").join(by_leaf, ["host", "template"])
    verdicts = by_path.select("host", "path", F.col("shown").alias("template"), "purity")
    method = F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(verdicts, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "template", "purity"
    )
