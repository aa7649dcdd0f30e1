"""The similarity graph: nearest-neighbour edges, their replacement rule, and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.functions.vectors import dot
from heatgraph.operators.cells import fit_cells, search_cells
from heatgraph.operators.knn import rank_within, search_all


def knn_edges(vectors: DataFrame, sources: DataFrame | None = None, k: int = 8, min_sim: float = 0.55, exact_rows: int | None = None) -> DataFrame:
    """``src, dst, weight, rank``: up to k nearest others of each source, at ``min_sim`` or more.

    The lists are exact, however many vectors there are. Only a caller that names ``exact_rows`` gets, for more vectors than
    that, lists from ``cells`` fitted to a recall of 0.95.

    ``vectors(id, vector)``; ``sources(id)`` defaults to all ids. Ties go to the smaller id. Negative cosines count 0, so a
    floor of 0 admits them.
    """
    own = vectors if sources is None else vectors.join(sources.select("id"), "id", "left_semi")
    queries = own.select(F.col("id").alias("query_id"), "id", "vector")
    if exact_rows is not None and vectors.count() > exact_rows:
        near = search_cells(vectors, queries, fit_cells(vectors.select("id", "vector"), k), k, min_sim, "id")
    else:
        near = search_all(vectors, queries, k, min_sim, "id")
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("sim").alias("weight"), "rank")


def subchunk_edges(subs: DataFrame, chunks: DataFrame, sources: DataFrame | None = None, k: int = 8, min_sim: float = 0.55, near_dup: float = 0.9) -> DataFrame:
    """``src, dst, weight`` between chunks by their closest parts, exact however many parts there are.

    Each part of ``subs(chunk_id, ord, vector)`` finds its k nearest parts of other chunks, ties in order of chunk and ``ord``; a pair
    of chunks has the highest similarity found, at ``min_sim`` or more; pairs whose whole vectors in ``chunks(id, vector)`` are as
    close as ``near_dup`` are dropped.
    """
    part = F.struct("chunk_id", "ord")
    named = lambda df, name: df.select(part.alias(name), "chunk_id", "vector")
    own = subs if sources is None else subs.join(sources.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    near = search_all(named(subs, "id"), named(own, "query_id"), k, min_sim, "chunk_id")
    near = near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "sim")
    pairs = near.groupBy(F.col("a.chunk_id").alias("src"), F.col("b.chunk_id").alias("dst")).agg(F.max("sim").alias("weight"))
    both = pairs.join(chunks.select(F.col("id").alias("src"), F.col("vector").alias("x")), "src").join(chunks.select(F.col("id").alias("dst"), F.col("vector").alias("y")), "dst")
    return both.filter(dot("x", "y") < near_dup).select("src", "dst", "weight")


def affected_ids(found: DataFrame) -> DataFrame:
    """``id``: targets of the lists ``found(src, dst)`` that have no list of their own."""
    return found.select(F.col("dst").alias("id")).distinct().join(found.select(F.col("src").alias("id")), "id", "left_anti")


def replace_edges(old: DataFrame, lists: DataFrame, keys: DataFrame) -> DataFrame:
    """``src, dst, weight`` (src < dst) after giving each of ``keys(id, ord)`` its list, in order of ``ord``.

    Giving a node its list first removes all its edges. So an old edge stays if neither end is a key, and an edge of a
    list stays unless its other end is given its list later: decided without going through the nodes one by one.
    """
    touched = keys.select("id")
    kept = old.join(touched.withColumnRenamed("id", "src"), "src", "left_anti").join(touched.withColumnRenamed("id", "dst"), "dst", "left_anti")
    of = lists.join(keys.select(F.col("id").alias("src"), F.col("ord").alias("o1")), "src").join(keys.select(F.col("id").alias("dst"), F.col("ord").alias("o2")), "dst", "left")
    new = of.filter("o2 is null or o1 > o2").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return kept.select("src", "dst", "weight").unionByName(new)


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, neighbor, weight, rank`` of the rows of ``ids(id)``, heaviest first, ties by id."""
    near = symmetric(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "weight")
    return rank_within(near, ["id"], 2**31 - 1, [F.desc("weight"), F.asc("neighbor")])


def delete_incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with no end in ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree, heaviest`` of every node with an edge."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.max("weight").alias("heaviest"))
