"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.checkpoints import cut


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of edges, edges that tie its nodes to the smallest one they are connected to in the batch."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        u, v = at[: len(batch)], at[len(batch) :]
        p = np.arange(len(nodes))
        while (apart := p[u] != p[v]).any():
            a, b = p[u[apart]], p[v[apart]]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(q := p[p], p):
                p = q
        on = np.flatnonzero(p != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[p[on]])], names=["src", "dst"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges(src, dst)``.

    ``component`` is the smallest node reachable. Nulls and self loops are ignored, repeated edges are harmless, and no
    edges give no rows. Each round is two groupBy/join pairs: minima are combined before the shuffle and the joins are
    plain equi-joins, so a hub is split by adaptive skew handling instead of being gathered in one task. A round at
    least halves the depth of the trees; lineage is cut by a shared checkpoint each round. Before the first one every
    batch of edges is replaced by stars, which keeps what is connected and leaves the rounds less to do. Nodes are longs.
    """
    e = edges.select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst"))
    e = e.filter("dst is not null")
    e = e.filter("src > dst").distinct().mapInArrow(_stars, "src long, dst long")
    e = cut(e.distinct())
    state = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src > dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.greatest("dst", "m").alias("src"), F.col("m").alias("dst"))
        e = cut(small.unionByName(low.select("src", F.col("m").alias("dst"))).filter("src > dst").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("dst").alias("node")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
