"""Approximate top-k by cosine: rows are dealt into cells around centres, and a query looks at the cells nearest to it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.functions.vectors import DIGITS
from heatgraph.operators.knn import as_bytes, as_matrix, owner_codes, rank_within, search_batch


@dataclass(frozen=True)
class Cells:
    """Unit vectors that cells lie around, how many of them a query looks at, and the recall measured with that."""

    centres: np.ndarray
    probes: int
    recall: float


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _packed(vectors: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of rows that are few enough for the driver, sent there as four bytes a number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id"), as_bytes(_unit(as_matrix(batch.column("v"))))], names=["id", "x"])

    work = vectors.select("id", F.col("vector").cast("array<double>").alias("v"))
    got = work.mapInArrow(pack, f"id {work.schema['id'].dataType.simpleString()}, x binary").toArrow()
    return got.column("id").to_pylist(), _unpacked(got.column("x"), np.float32) if len(got) else np.zeros((0, 1), np.float32)


def fit_cells(vectors: DataFrame, k: int = 8, recall: float = 0.95, most_cells: int = 4096, sample_bytes: int = 64 << 20, asked: int = 200, seed: int = 5) -> Cells:
    """Cells for ``vectors(id, vector)``: about the root of the rows, at most ``most_cells``.

    Centres are means of a sample of at most ``sample_bytes`` of distinct vectors, those whose ids have the lowest hash
    (the bound is on fitting; every row is indexed). How many cells a query looks at is measured: for ``asked`` of the
    sample the k nearest are found exactly, over all rows, and the least number is taken at which ``recall`` of them lie in the
    cells looked at.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, sample_bytes // (4 * (width or 1)))
    # hashes are even over the longs, so the share of the lowest ones is the share of the rows
    lowest = vectors if n <= most else vectors.filter(F.xxhash64("id") < int(-(2**63) + 2**64 * (most / n)))
    x = _packed(lowest)[1][:most]
    x = np.unique(x, axis=0) if len(x) else np.zeros((1, width or 1), np.float32)
    count = int(min(most_cells, max(1, round(n**0.5)), len(x)))
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), count, replace=False)]
    for _ in range(8):
        near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums, order = np.zeros_like(centres), np.argsort(near, kind="stable")
        had, first = np.unique(near[order], return_index=True)
        sums[had] = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    queries = vectors.orderBy(F.xxhash64("id"), "id").limit(asked).select(F.col("id").alias("query_id"), "id", "vector")
    truth = search_batch(vectors, queries, k, owner="id").select(F.col("query_id").alias("q"), "id").join(vectors, "id")  # k rows for each asked one
    pairs = truth.select(F.struct("q", "id").alias("id"), "vector")
    asked_ids, asked_x = _packed(queries.select("id", "vector"))
    found_ids, found_x = _packed(pairs)
    if not found_ids:
        return Cells(centres, count, 1.0)
    at = {i: j for j, i in enumerate(asked_ids)}
    order = asked_x[[at[p["q"]] for p in found_ids]] @ centres.T
    cell = (found_x @ centres.T).argmax(1)
    place = (order > order[np.arange(len(cell)), cell][:, None]).sum(1) + 1  # the how manieth cell each neighbour lies in
    found = [float((place <= p).mean()) for p in range(1, count + 1)]
    probes = next((p for p, share in enumerate(found, 1) if share >= recall), count)
    return Cells(centres, probes, found[probes - 1])


def _groups(centres: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells in groups of centres that lie together, with at most ``most`` rows each, or one cell: halved along their widest direction."""
    done, open_ = [], [np.arange(len(centres))]
    while open_:
        cells = open_.pop()
        if len(cells) == 1 or rows[cells].sum() <= most:
            done.append(cells)
            continue
        spread = centres[cells] - centres[cells].mean(0)
        cells = cells[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        half = np.cumsum(rows[cells])
        cut = int(np.clip(np.searchsorted(half, half[-1] / 2) + 1, 1, len(cells) - 1))
        open_ += [cells[cut:], cells[:cut]]
    return done


def search_cells(vectors: DataFrame, queries: DataFrame, cells: Cells, k: int, floor: float = 0.0, owner: str | None = None, slice_rows: int = 16_384, block: int = 65_536) -> DataFrame:
    """``query_id, id, sim, rank`` as ``knn.search_batch`` gives them, of the rows in the cells nearest to each query.

    Similarities are exact; only rows of other cells can be missing. Every row of ``vectors(id, vector)`` is in one cell. Cells
    whose centres lie together are a group of up to ``slice_rows`` rows, and a query is sent once to each group that has some of
    its cells; it comes back with k rows of them all. A cell with more rows is a group of its own and cut into slices, and
    the queries of a group into blocks, so a cell with a third of all rows is spread over as many tasks as its share asks for.
    """
    own = F.col(owner) if owner else F.lit(None).cast("long")
    sc = queries.sparkSession.sparkContext

    def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of each row's nearest centres, in ascending order."""
        if probes >= len(centres):
            return np.tile(np.arange(len(centres)), (len(x), 1))
        if x.shape[1] != centres.shape[1]:  # cells that were fitted to no rows know no width
            return np.tile(np.arange(probes), (len(x), 1))
        x, out = _unit(x), []
        for a in range(0, len(x), 2048):
            order = x[a : a + 2048] @ centres.T
            out.append(order.argmax(1)[:, None] if probes == 1 else np.sort(np.argpartition(-order, probes - 1, 1)[:, :probes], 1))
        return np.concatenate(out)

    plain = sc.broadcast(cells.centres)  # at most most_cells centres

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, n = np.unique(nearest(as_matrix(batch.column("v")), plain.value, 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    held = vectors.select(F.col("vector").cast("array<double>").alias("v")).mapInArrow(count, "cell int, n long")
    sizes = np.zeros(len(cells.centres), np.int64)
    for r in held.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a number for each cell
        sizes[r["cell"]] = r["n"]
    groups = _groups(cells.centres, sizes, slice_rows)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    # numbered anew, so that the cells of a group follow each other
    sent = sc.broadcast((cells.centres[np.concatenate(groups)], group))

    def deal(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        centres, group = sent.value
        for batch in batches:
            if len(batch):
                x = as_matrix(batch.column("v"))
                near = nearest(x, centres, probes)
                of = group[near]
                first = np.ones(near.shape, bool)
                first[:, 1:] = of[:, 1:] != of[:, :-1]
                i, j = np.nonzero(first)
                ends = np.append(np.flatnonzero(first), near.size).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(i)), batch.column("o").take(pa.array(i)), as_bytes(x).take(pa.array(i)), pa.array(of[i, j], pa.int32()), lists], names=["key", "o", "x", "unit", "cells"])

    def dealt(df: DataFrame, key: str, probes: int) -> DataFrame:
        work = df.select(F.col(key).alias("key"), own.alias("o"), F.col("vector").cast("array<double>").alias("v"))
        kinds = ", ".join(f"{c} {work.schema[c].dataType.simpleString()}" for c in ("key", "o")) + ", x binary, unit int, cells array<int>"
        return work.mapInArrow(lambda batches: deal(batches, probes), kinds)

    rows, asked = dealt(vectors, "id", 1), dealt(queries, "query_id", cells.probes)
    slices = [max(1, -(-int(sizes[g].sum()) // slice_rows)) for g in groups]
    meeting = {r["unit"]: r["count"] for r in asked.groupBy("unit").count().collect()}  # a number for each group
    blocks = [max(1, -(-meeting.get(g, 0) // block)) for g in range(len(groups))]
    number = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("unit") + 1).cast("long")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), number(of) - 1))
    share = lambda of: F.pmod(F.xxhash64("key"), number(of))
    rows = rows.select("unit", share(slices).alias("slice"), every(blocks).alias("block"), "key", "o", "x", "cells")
    asked = asked.select("unit", every(slices).alias("slice"), share(blocks).alias("block"), "key", "o", "x", "cells")
    kinds = f"query_id {asked.schema['key'].dataType.simpleString()}, id {rows.schema['key'].dataType.simpleString()}, sim double"
    place = ["unit", "slice", "block"]
    found = rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(lambda left, right: _meet(left, right, k, floor), kinds)
    return rank_within(found, ["query_id"], k, [F.desc("sim"), F.asc("id")])


def _meet(rows: pa.Table, asked: pa.Table, k: int, floor: float, tile: int = 1024) -> pa.Table:
    """The k best of a group's rows for each query, among the cells the query looks at; ties go to the smaller ids.

    ``tile`` queries and four times as many rows of a cell are multiplied at a time. What a query has found before bounds what is looked at next.
    """
    names = ["query_id", "id", "sim"]
    if not len(rows) or not len(asked) or k <= 0:
        return pa.table([asked.column("key").slice(0, 0), rows.column("key").slice(0, 0), pa.array([], pa.float64())], names=names)
    rows = rows.sort_by("key")  # places are in the order of ids
    v, q = _unpacked(rows.column("x"), np.float64), _unpacked(asked.column("x"), np.float64)
    mine, other = owner_codes(rows.column("o"), asked.column("o"))
    lists = asked.column("cells").combine_chunks()
    looks = np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy())
    wanted = lists.flatten().to_numpy()
    order = np.argsort(wanted, kind="stable")
    looks, wanted = looks[order], wanted[order]
    cell_of = rows.column("cells").combine_chunks().flatten().to_numpy()
    order = np.argsort(cell_of, kind="stable")
    cell_of = cell_of[order]
    sim, at, low = np.full((len(asked), k), -1.0), np.full((len(asked), k), -1), max(floor, 0.0)
    edges, slack = np.unique(cell_of), 10.0**-DIGITS
    for cell in edges:
        here = order[slice(*np.searchsorted(cell_of, [cell, cell + 1]))]
        who = looks[slice(*np.searchsorted(wanted, [cell, cell + 1]))]
        for b in range(0, len(here), 4 * tile):
            r = here[b : b + 4 * tile]
            by_owner = np.argsort(mine[r], kind="stable")
            owners = mine[r][by_owner]
            for a in range(0, len(who), tile):
                w = who[a : a + tile]
                s = np.clip(q[w] @ v[r].T, 0, 1)
                left, right = np.searchsorted(owners, other[w], "left"), np.searchsorted(owners, other[w], "right")
                n = right - left
                s[np.repeat(np.arange(len(w)), n), by_owner[np.arange(n.sum()) + np.repeat(left - np.cumsum(n) + n, n)]] = -1.0
                on = s >= np.maximum(sim[w, -1], low)[:, None] - slack
                many = np.flatnonzero(on.sum(1) > 4 * k)
                if len(many) and len(r) > k:
                    on[many] &= s[many] >= np.partition(s[many], len(r) - k, 1)[:, len(r) - k][:, None] - slack
                    for i in many[on[many].sum(1) > 4 * k]:  # of ties only the smallest ids can be ranked
                        tied = np.flatnonzero(on[i])
                        on[i, tied[np.argsort(-np.round(s[i, tied], DIGITS), kind="stable")[k:]]] = False
                i, j = np.nonzero(on)
                new = np.round(s[i, j], DIGITS)
                i, j, new = (x[new >= low] for x in (i, j, new))
                if not len(i):
                    continue
                had, place = np.nonzero(at[w] >= 0)
                i, p, new = np.concatenate([i, had]), np.concatenate([r[j], at[w][had, place]]), np.concatenate([new, sim[w][had, place]])
                by = np.lexsort((p, -new, i))
                i, p, new = i[by], p[by], new[by]
                rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
                top = rank < k
                sim[w[i[top]], rank[top]], at[w[i[top]], rank[top]] = new[top], p[top]
    i, place = np.nonzero(at >= 0)
    return pa.table([asked.column("key").take(pa.array(i)), rows.column("key").take(pa.array(at[i, place])), pa.array(sim[i, place])], names=names)
