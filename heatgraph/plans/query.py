"""Answering batches of queries: fan-out, fusion, heat, reranking, combination and projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.checkpoints import cut
from heatgraph.errors import HeatgraphError
from heatgraph.functions.blanks import is_blank
from heatgraph.functions.providers import Embedder, Generator, Reranker, embed_rows, generate_rows, rerank_rows
from heatgraph.functions.vectors import DIGITS, dot
from heatgraph.operators import ranking
from heatgraph.operators.expansion import expand, prompt, variant_list
from heatgraph.operators.knn import search_batch
from heatgraph.operators.traversal import heat_by_hop, heat_in_order
from heatgraph.plans.config import Config


@dataclass(frozen=True)
class Options:
    top: int = 8
    expand: bool = False
    graph: bool = True
    rerank: bool = False
    hops: int | None = None
    explain: bool = False
    exact_order: bool = True


def _checked(queries: DataFrame) -> DataFrame:
    blank = F.raise_error(F.concat(F.lit("a blank query: "), F.col("query_id").cast("string")))
    return queries.select("query_id", F.when(is_blank("query"), blank).otherwise(F.col("query")).alias("query"))


def run_query(tables: Mapping[str, DataFrame], queries: DataFrame, config: Config = Config(), options: Options = Options(), embedder: Embedder | None = None, generator: Generator | None = None, reranker: Reranker | None = None) -> DataFrame:
    """``query_id, query, rank, id, file, line_start, ..., text, vector, heat, rerank, score, explain``.

    ``queries(query_id, query)``; a single query is a batch of one. Every stage is a join or window keyed by query, so
    queries never meet on the driver. An empty index gives no rows; without a reranker nothing is reranked.
    """
    s, g = config.scoring, config.graph
    queries = _checked(queries)
    if options.expand and generator is not None:
        answers = generate_rows(queries.withColumn("prompt", prompt("query", config.expansion.variants, config.expansion.hyde)), generator)
        variants = variant_list(queries.join(expand(answers, config.expansion.variants, config.expansion.hyde), "query_id"))
    else:
        variants = queries.select("query_id", F.lit(0).alias("variant"), F.col("query").alias("text"))
    vectors = tables["chunk_vectors"].select(F.col("chunk_id").alias("id"), "vector")
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("variant").cast("string"))
    asked = cut(embed_rows(variants.withColumn("key", key), embedder, "key", "text", queries=True))
    part = lambda i, kind: F.split_part("query_id", F.lit(":"), F.lit(i)).cast(kind)
    found = search_batch(vectors, asked.select(F.col("key").alias("query_id"), "vector"), s.per_query_top)
    rankings = found.select(part(2, "int").alias("variant"), part(1, "long").alias("q"), "id", "rank").withColumnRenamed("q", "query_id")
    fused = cut(ranking.rrf(rankings, s.rrf_k))
    if options.graph:
        first = asked.filter(F.split_part("key", F.lit(":"), F.lit(2)) == "0").select(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("query_id"), F.col("vector").alias("qv"))
        hops = g.hops if options.hops is None else options.hops
        sims = _near_sims(vectors, first)
        walk = heat_in_order if options.exact_order else heat_by_hop
        heat = walk(fused.select("query_id", "id", F.col("fused").alias("heat")), tables["edges"], sims, hops, g.decay, g.query_floor, g.max_frontier)
        scores = fused.join(heat, ["query_id", "id"], "full").withColumnRenamed("fused", "vector")
    else:
        scores = fused.select("query_id", "id", F.col("fused").alias("vector"), F.col("fused").alias("heat"))
        scores = scores.select("*", F.col("id").alias("seed"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("edge_weight"), F.lit(0).alias("hop"))
    scores = scores.withColumn("explain", F.struct("seed", "parent", "edge_weight", "hop")).drop("seed", "parent", "edge_weight", "hop")
    scored = ranking.combine(scores, s.alpha, s.beta, s.gamma)
    if options.rerank and reranker is not None:
        short = rerank_rows(ranking.shortlist(scored, tables["chunks"], s.shortlist).drop("score"), queries, reranker)
        scored = ranking.combine(short.drop("text"), s.alpha, s.beta, s.gamma, rerank=True)
    else:
        scored = scored.withColumn("rerank", F.lit(0.0))
    best = ranking.top_n(scored, options.top)
    about = tables["chunks"].withColumnRenamed("file_path", "file")
    out = best.join(about, "id").join(queries, "query_id")
    explain = F.col("explain") if options.explain else F.lit(None).cast(best.schema["explain"].dataType)
    return out.select("query_id", "query", "rank", "id", "file", "line_start", "line_end", "byte_start", "byte_end", "text", "vector", "heat", "rerank", "score", explain.alias("explain"))


def _near_sims(vectors: DataFrame, asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Similarities to the query itself, for the pairs ``query_id, id`` that a hop of the traversal reaches."""
    sim = F.round(F.greatest(F.lit(0.0), dot("vector", "qv")), DIGITS)
    return lambda wanted: wanted.join(vectors, "id").join(asked, "query_id").select("query_id", "id", sim.alias("sim"))


def check_model(manifest: Mapping[str, str], config: Config) -> None:
    """Fails if the index was embedded with another model than the configuration names."""
    if manifest.get("embedding_model") not in (None, config.embedder.model):
        raise HeatgraphError(f"the index was embedded with {manifest['embedding_model']}, the configuration has {config.embedder.model}")
