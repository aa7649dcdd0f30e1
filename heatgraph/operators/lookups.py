"""Lookups and reports over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.operators.edges import neighbors


def get_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks of ``wanted(id, ord)`` in its order; unknown ids are left out."""
    return wanted.join(chunks, "id").orderBy("ord")


def file_hashes(files: DataFrame) -> DataFrame:
    """The hash of every file's content."""
    return files.select("path", "content_hash")


def chunk_ids_for_file(chunks: DataFrame, path: str) -> DataFrame:
    """The ids of one file's chunks, in order."""
    return chunks.filter(F.col("file_path") == path).select("id").orderBy("id")


def all_chunk_ids(chunks: DataFrame) -> DataFrame:
    """The ids of all chunks, in order."""
    return chunks.select("id").orderBy("id")


def counts(files: DataFrame, chunks: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: files, chunks, edges, communities."""
    one = [files.agg(F.count("*").alias("files")), chunks.agg(F.count("*").alias("chunks")), edges.agg(F.count("*").alias("edges")), communities.agg(F.countDistinct("community_id").alias("communities"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # single rows
    return out


def inspect_neighbors(edges: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbours of ``ids(id)`` with their files and lines, which are null if the chunk is gone; weights to 6 digits."""
    near = neighbors(edges, ids)
    about = chunks.select(F.col("id").alias("neighbor"), "file_path", "line_start", "line_end")
    return near.join(about, "neighbor", "left").select("id", "rank", "neighbor", "file_path", "line_start", "line_end", F.round("weight", 6).alias("weight"))


def inspect_chunks(edges: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Each chunk with its neighbours as one array."""
    near = inspect_neighbors(edges, chunks, ids).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "file_path", "weight"))).alias("edges"))
    return chunks.join(ids, "id", "left_semi").join(near, "id", "left")


def inspect_files(files: DataFrame, chunks: DataFrame, paths: DataFrame, preview: int = 80) -> DataFrame:
    """``path, content_hash, chunk_count, id, line_start, line_end, preview`` of the chunks of each file."""
    own = chunks.select(F.col("file_path").alias("path"), "id", "line_start", "line_end", F.substring("text", 1, preview).alias("preview"))
    rows = files.join(paths, "path", "left_semi").select("path", "content_hash")
    n = own.groupBy("path").agg(F.count("*").alias("chunk_count"))
    return rows.join(n, "path").join(own, "path").select("path", "content_hash", "chunk_count", "id", "line_start", "line_end", "preview")


def community_members(members: DataFrame, chunks: DataFrame, community_id: int) -> DataFrame:
    """The chunks of one community with their files and lines, in order; none if there is no such community."""
    own = members.filter(F.col("community_id") == community_id)
    return own.join(chunks.select(F.col("id").alias("chunk_id"), "file_path", "line_start", "line_end"), "chunk_id").orderBy("chunk_id")
