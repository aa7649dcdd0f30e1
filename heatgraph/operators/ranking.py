"""Rank fusion, score combination, shortlists and result projections; every step is keyed by ``query_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.operators.knn import rank_within


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, id, fused``: sums of 1 / (k + rank) over ``rankings(query_id, variant, id, rank)``.

    Terms are added in order of variant, so the sum doesn't depend on the shuffle; there is one for each variant.
    """
    terms = rankings.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("variant", (1.0 / (F.lit(k) + F.col("rank"))).alias("t")))).alias("ts"))
    return terms.select("query_id", "id", F.aggregate("ts", F.lit(0.0), lambda s, x: s + x["t"]).alias("fused"))


def min_max(score: Column | str, keys: list[str]) -> Column:
    """Scaled to 0..1 within its group; if all are equal, 1."""
    by = Window.partitionBy(*keys)
    low, high = F.min(score).over(by), F.max(score).over(by)
    score = F.col(score) if isinstance(score, str) else score
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def combine(scores: DataFrame, alpha: float = 0.6, beta: float = 0.25, gamma: float = 0.15, rerank: bool = False) -> DataFrame:
    """``scores(query_id, id, vector, heat[, rerank])`` with ``score``; a missing signal counts 0 before scaling."""
    names = ["vector", "heat"] + (["rerank"] if rerank else [])
    filled = scores.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    scaled = filled.withColumns({f"_{c}": min_max(c, ["query_id"]) for c in names})
    if rerank:
        total = alpha * F.col("_rerank") + beta * F.col("_heat") + gamma * F.col("_vector")
    else:
        total = (beta * F.col("_heat") + gamma * F.col("_vector")) / (beta + gamma) if beta + gamma else F.lit(0.0)
    return scaled.withColumn("score", total).drop(*(f"_{c}" for c in names))


def top_n(scored: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best of each query, with their ``rank``; ties by id."""
    return rank_within(scored, ["query_id"], n, [F.desc(score), F.asc("id")])


def shortlist(scored: DataFrame, chunks: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` best of each query that exist in ``chunks(id, text)``, with their texts."""
    return top_n(scored, most).drop("rank").join(chunks.select("id", "text"), "id")


def lexical_rerank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``candidates`` with ``rerank``: the share of the query's distinct words that the text has. A deterministic stand-in."""
    from heatgraph.functions.vectors import words

    q = queries.select("query_id", F.array_distinct(words("query")).alias("q"))
    share = F.size(F.array_intersect("q", words("text"))) / F.greatest(F.size("q"), F.lit(1))
    return candidates.join(q, "query_id").withColumn("rerank", share).drop("q")


def file_scores(results: DataFrame) -> DataFrame:
    """``query_id, file, score, chunk_ids, position`` from ``results(query_id, rank, id, file, score)``.

    A file's score is the sum of its three best results, to 6 digits; files with equal scores keep the order of their
    first results.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "file").orderBy(F.desc("score"), "rank"))
    rows = results.withColumn("r", best)
    one = F.array_sort(F.collect_list(F.struct("r", "score", "id")))
    files = rows.groupBy("query_id", "file").agg(one.alias("rs"), F.min("rank").alias("first"))
    total = F.aggregate(F.slice("rs", 1, 3), F.lit(0.0), lambda s, x: s + x["score"])
    files = files.select("query_id", "file", F.round(total, 6).alias("score"), F.transform("rs", lambda x: x["id"]).alias("chunk_ids"), "first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    return files.withColumn("position", place).drop("first")


def result_json(results: DataFrame, max_chars: int = 1200, schema: str = "heatgraph.query.v1") -> DataFrame:
    """``query_id, json``: one document for each query, of ``results(query_id, query, rank, id, file, ..., score, text)``."""
    r = F.struct(
        F.col("id").alias("chunk_id"), "file", "line_start", "line_end", "byte_start", "byte_end", F.round("score", 6).alias("score"),
        F.struct(*(F.round(c, 6).alias(c) for c in ("vector", "heat", "rerank"))).alias("breakdown"),
        F.substring("text", 1, max_chars).alias("text"), (F.length("text") > max_chars).alias("truncated"), "explain",
    )
    docs = results.groupBy("query_id").agg(F.max("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", r.alias("r")))).alias("rs"))
    return docs.select("query_id", F.to_json(F.struct(F.lit(schema).alias("schema"), "query", F.transform("rs", lambda x: x["r"]).alias("results"))).alias("json"))
