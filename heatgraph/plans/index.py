"""Building and maintaining an index: difference, cascade, chunks, vectors, edges, communities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.checkpoints import cut
from heatgraph.errors import ConfigError, HeatgraphError
from heatgraph.functions.chunking import chunk_files, split_sentences
from heatgraph.functions.providers import Embedder, embed_rows
from heatgraph.operators.communities import communities
from heatgraph.operators.edges import affected_ids, knn_edges, replace_edges, subchunk_edges
from heatgraph.operators.maintenance import assign_ids, cascade_delete, check_manifest, diff, upsert
from heatgraph.plans.config import Config
from heatgraph.sources.snapshots import Snapshots


def _edge_lists(tables: Mapping[str, DataFrame], sources: DataFrame, config: Config) -> DataFrame:
    g = config.graph
    vectors = tables["chunk_vectors"].select(F.col("chunk_id").alias("id"), "vector")
    if g.edge_source == "subchunk":
        bare = tables["chunk_vectors"].join(tables["subchunks"], "chunk_id", "left_anti").limit(1).count()
        if bare:
            raise HeatgraphError("some chunks have no sub-chunk vectors: rebuild the index in full")
        return subchunk_edges(tables["subchunks"], vectors, sources, g.k, g.min_edge_sim, g.near_dup_sim)
    return knn_edges(vectors, sources, g.k, g.min_edge_sim).select("src", "dst", "weight")


def build(previous: Mapping[str, DataFrame], files: DataFrame, config: Config, embedder: Embedder | None = None, highest: int = 0, full: bool = False) -> dict[str, DataFrame]:
    """The tables of the next version, and ``change(path, change)``.

    ``files(path, content_hash, mtime, text)``. Only new and changed files are chunked and embedded. Nodes whose lists are
    new are re-edged in order of id, then the old nodes they touch; a full build starts from nothing, with new ids.
    """
    if config.graph.edge_source not in ("chunk", "subchunk"):
        raise ConfigError("edge_source is chunk or subchunk")
    spark = files.sparkSession
    if full:
        previous = {n: spark.createDataFrame([], t.schema) for n, t in previous.items()}
    change = cut(diff(previous["files"], files))
    stale = change.filter("change in ('changed', 'deleted')").select("path")
    left = cascade_delete(previous, stale)
    todo = files.join(change.filter("change in ('new', 'changed')").select("path"), "path", "left_semi")
    drafts = chunk_files(todo, config.chunking.size_tokens, config.chunking.overlap)
    fresh = cut(assign_ids(drafts, highest).drop("pos"))
    new_vectors = cut(embed_rows(fresh, embedder, "id").withColumnRenamed("id", "chunk_id"))
    n = fresh.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("chunk_count"))
    rows = todo.select("path", "content_hash", "mtime").join(n, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    out = {
        "files": upsert(left["files"], rows, "path"),
        "chunks": left["chunks"].unionByName(fresh.select(left["chunks"].columns)),
        "chunk_vectors": left["chunk_vectors"].unionByName(new_vectors),
        "subchunks": left["subchunks"],
    }
    if config.graph.edge_source == "subchunk":
        parts = split_sentences(fresh.select("id", "text"), config.graph.subchunk_size_tokens)
        several = parts.groupBy("chunk_id").count().filter("count > 1").select("chunk_id")
        # a chunk that is its own only part has its vector already
        one = new_vectors.join(several, "chunk_id", "left_anti").select("chunk_id", F.lit(0).alias("ord"), "vector")
        keyed = parts.join(several, "chunk_id", "left_semi").withColumn("key", F.to_json(F.struct("chunk_id", "ord")))
        many = embed_rows(keyed, embedder, "key").select(F.from_json("key", "chunk_id long, ord int").alias("k"), "vector").select("k.*", "vector")
        out["subchunks"] = cut(left["subchunks"].unionByName(one).unionByName(many))
    ids = fresh.select("id")
    first = cut(_edge_lists(out, ids, config))
    touched = cut(affected_ids(first.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")))))
    second = _edge_lists(out, touched, config)
    keys = ids.select("id", F.struct(F.lit(0).alias("turn"), "id").alias("ord")).unionByName(touched.select("id", F.struct(F.lit(1).alias("turn"), "id").alias("ord")))
    out["edges"] = cut(replace_edges(left["edges"], first.unionByName(second), keys))
    out["communities"] = communities(out["edges"], config.graph.resolution, config.graph.seed)
    out["change"] = change
    return out


def run_index(store: Snapshots, files: DataFrame, config: Config, embedder: Embedder | None = None, full: bool = False) -> DataFrame:
    """Writes the next version and returns its counters in one row: files indexed, unchanged, deleted; chunks, edges, communities."""
    manifest = store.manifest()
    check_manifest(manifest, config.manifest(), full)
    highest = int(manifest.get("highest_id", 0))
    tables = build(store.tables(), files, config, embedder, highest, full)
    fresh = tables["chunks"].agg(F.max("id")).first()[0]
    store.write({k: v for k, v in tables.items() if k != "change"}, {**config.manifest(), "highest_id": max(highest, fresh or 0)})
    count = lambda *names: F.count_if(F.col("change").isin(*names))
    changes = tables["change"].agg(count("new", "changed").alias("indexed"), count("unchanged").alias("unchanged"), count("deleted").alias("deleted") if not full else F.lit(0).cast("long").alias("deleted"))
    sizes = [store.table("chunks").agg(F.count("*").alias("chunks")), store.table("edges").agg(F.count("*").alias("edges")), store.table("communities").agg(F.countDistinct("community_id").alias("communities"))]
    for s in sizes:
        changes = changes.crossJoin(s)  # single rows
    return changes
