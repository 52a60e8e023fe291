"""Full-text search: AND of literal phrases, BM25 order.

`search` scans texts with built-in expressions.  `build_index` writes a term
index for repeated queries; its postings are split by term and document hash so
that a very common term is spread over many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import textops

K1 = 1.2
B = 0.75
MIN_IDF = 1e-6


def query_phrases(df: DataFrame, query: str) -> list[list[str]]:
    """Token lists of the whitespace-separated terms, tokenised like the texts."""
    if not query.strip() or len(query) > 500:
        raise ValueError("search_requires_1_to_500_characters")
    terms = query.split()
    tokens = df.sparkSession.range(1).select(
        *[textops.search_tokens(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]
    ).first()
    return [list(t) for t in tokens if t]


def _hits(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    at = lambda i: F.forall(
        F.sequence(F.lit(0), F.lit(len(phrase) - 1)),
        lambda j: F.get(tokens, (i + j).cast("int")) == F.get(F.array(*[F.lit(p) for p in phrase]), j.cast("int")),
    )
    starts = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.get(tokens, i) == phrase[0])
    return F.size(F.filter(starts, lambda i: F.coalesce(at(i), F.lit(False))))


def _score(stats: DataFrame, matched: DataFrame, n: int) -> DataFrame:
    """BM25 with document frequencies from a one-row statistics table."""
    total = F.lit(0.0)
    for i in range(n):
        df, tf = F.col(f"_df{i}"), F.col(f"_tf{i}").cast("double")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))
        norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
        total = total + idf * tf * (K1 + 1) / (tf + norm)
    names = [f"_df{i}" for i in range(n)] + ["_n", "_avg"]
    row = stats.select(F.struct(*names).alias("_s")).scalar()
    with_stats = matched.withColumn("_s", row).select("*", "_s.*")
    return with_stats.withColumn("score", -total).drop(
        "_s", "_len", *names, *[f"_tf{i}" for i in range(n)]
    )


def search(
    records: DataFrame,
    query: str,
    limit: int = 20,
    id_column: str = "record_id",
    text_column: str = "text",
    scope: Column | None = None,
) -> DataFrame:
    """Best `limit` records by (score, id); frequencies come from all records.

    `scope` filters matches (project, provider, actor) without changing scores.
    """
    phrases = query_phrases(records, query)
    if not phrases:
        return records.withColumn("score", F.lit(0.0)).filter("false")
    tokens = F.col("_tokens")
    counted = records.withColumn("_tokens", textops.search_tokens(F.col(text_column))).select(
        *records.columns,
        F.size(tokens).alias("_len"),
        *[_hits(tokens, p).alias(f"_tf{i}") for i, p in enumerate(phrases)],
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_len").alias("_avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))],
    )
    every = F.lit(True)
    for i in range(len(phrases)):
        every = every & (F.col(f"_tf{i}") > 0)
    matched = counted.filter(every)
    if scope is not None:
        matched = matched.filter(scope)
    scored = _score(stats, matched, len(phrases))
    return scored.orderBy(F.col("score"), F.col(id_column)).limit(limit)


def _places(tokens: Column) -> Column:
    """Per distinct token, in order: the token and its positions; linear in a sorted text."""
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    starts = lambda s: F.filter(
        F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"])
    )
    one = lambda s, at, to: F.struct(
        F.get(s, at)["term"].alias("term"), F.transform(F.slice(s, at + 1, to - at), lambda p: p["position"]).alias("positions")
    )
    cut = lambda s: textops.let(
        starts(s), lambda at: F.transform(at, lambda i, k: one(s, i, F.coalesce(F.get(at, k + 1), F.size(s))))
    )
    return F.when(F.size(tokens) > 0, textops.let(placed, cut))


def postings(records: DataFrame, id_column: str, text_column: str, term_buckets: int, document_buckets: int) -> DataFrame:
    """(term, id, positions, bucket, part) of the terms of every document.

    The places of a text are gathered in its own row, so one row per document and
    term is shuffled, once, and sorted once.
    """
    tokens = _tokens(records, id_column, text_column)
    rows = tokens.select("id", F.explode_outer(_places(F.col("tokens"))).alias("_one")).filter("_one is not null")
    dealt = rows.select(
        "_one.term", "id", "_one.positions",
        (F.pmod(F.xxhash64("_one.term"), F.lit(16 * term_buckets)) * document_buckets
         + F.pmod(F.xxhash64("id"), F.lit(document_buckets))).cast("int").alias("_deal"),
    ).repartition("_deal").withColumns(
        {
            "bucket": F.floor(F.col("_deal") / document_buckets).cast("int") % term_buckets,
            "part": F.col("_deal") % document_buckets,
        }
    )
    # Rows of one id are one document: their places meet in its first row.
    same = W.partitionBy("bucket", "_deal", "term", "id").orderBy("id")
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return dealt.select(
        "term", "id", F.array_sort(F.flatten(F.collect_list("positions").over(whole))).alias("positions"), "bucket", "part",
        F.row_number().over(same).alias("_nth"),
    ).filter("_nth = 1").drop("_nth")


def _tokens(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return records.select(F.col(id_column).alias("id"), textops.search_tokens(F.col(text_column)).alias("tokens"))


def build_index(
    records: DataFrame, path: str, id_column: str = "record_id", text_column: str = "text",
    term_buckets: int = 64, document_buckets: int = 8,
) -> None:
    """Write postings (term, id, tf, positions) and per-document lengths."""
    found = postings(records, id_column, text_column, term_buckets, document_buckets)
    found.write.mode("errorifexists").partitionBy("bucket").parquet(path + "/postings")
    lengths = _tokens(records, id_column, text_column).select("id", F.size("tokens").alias("length"))
    lengths.write.mode("errorifexists").parquet(path + "/lengths")


def search_index(
    spark, path: str, query: str, limit: int = 20, term_buckets: int = 64,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Search a written index; only the buckets of the query's terms are read.

    A query without tokens finds nothing, as in `search`.
    """
    lengths = spark.read.parquet(path + "/lengths")
    phrases = query_phrases(lengths, query)
    if not phrases:
        return lengths.select("id", F.lit(0.0).alias("score")).filter("false")
    postings = spark.read.parquet(path + "/postings")
    stats = lengths.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_avg"))
    matched = None
    for i, phrase in enumerate(phrases):
        hits = None
        for j, term in enumerate(phrase):
            bucket = F.pmod(F.xxhash64(F.lit(term)), F.lit(term_buckets)).cast("int")
            one = postings.filter((F.col("bucket") == bucket) & (F.col("term") == term)).select(
                "id", F.transform("positions", lambda p: p - j).alias(f"_s{j}")
            )
            hits = one.withColumnRenamed("_s0", "_at") if hits is None else hits.join(one, "id").select(
                "id", F.array_intersect("_at", f"_s{j}").alias("_at")
            )
        hits = hits.filter(F.size("_at") > 0).select("id", F.size("_at").alias(f"_tf{i}"))
        stats = stats.withColumn(f"_df{i}", hits.agg(F.count(F.lit(1))).scalar())
        matched = hits if matched is None else matched.join(hits, "id")
    with_length = matched.join(lengths.withColumnRenamed("length", "_len"), "id")
    if scope is not None:
        with_length = with_length.join(scope, "id", "left_semi")
    return _score(stats, with_length, len(phrases)).orderBy("score", "id").limit(limit)
