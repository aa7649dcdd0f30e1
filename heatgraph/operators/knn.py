"""Exact top-k by cosine: for a set of queries, and for all rows against each other in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.functions.vectors import DIGITS, dot, similarity


def rank_within(rows: DataFrame, keys: list[str], k: int, order: list) -> DataFrame:
    """The first k rows of each group, with their ``rank`` from 1. The limit is applied before the shuffle as well."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def search(vectors: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """``id, sim`` of the k rows most like one query: one scan and a distributed top-k."""
    if k <= 0:
        return vectors.select(id, F.lit(0.0).alias("sim")).limit(0)
    sims = vectors.select(id, similarity(vector, F.array(*map(F.lit, query))).alias("sim"))
    return sims.orderBy(F.desc("sim"), id).limit(k)


def _stack(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x.reshape(len(vectors), -1) if len(vectors) else x.reshape(0, 0)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.0, id: str = "id", vector: str = "vector", owner: str | None = None, block: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """``query_id, id, sim, rank`` of the k rows most like each row of ``queries(query_id, vector)``, at ``floor`` or more.

    With ``owner``, a column of both sides, rows of a query's own owner are left out before the best are taken. Queries
    of up to ``block_bytes`` (65,536 of 64 numbers), or ``block`` of them, are a bounded broadcast: the rows stay where they are, and a matrix
    product keeps k of a batch for each query before anything is shuffled. More queries are dealt into blocks of that size
    by a hash, rows into as many slices as there are partitions, and every block meets every slice once: the stated query
    set against all rows. For all rows against each other ``search_all`` gives the same rows in less time.
    """
    own = F.col(owner) if owner else F.lit(None).cast("long")
    asked = queries.select("query_id", own.alias("o"), F.col("vector").alias("v"))
    rows = vectors.select(F.col(id).alias("id"), own.alias("o"), F.col(vector).alias("v"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, sim double"
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // (block or max(1, block_bytes // (8 * (width or 1))))))
    if blocks == 1:
        sent = queries.sparkSession.sparkContext.broadcast(asked.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            matrix = _stack(q["v"])
            for pdf in batches:
                if len(pdf) and len(q):
                    yield best(q, matrix, pdf, k, floor)

        found = rows.mapInPandas(run, kinds)
    else:
        slices = vectors.sparkSession.sparkContext.defaultParallelism
        # numbers of one type on both sides: equal ones of other types are dealt to other partitions, and nothing meets
        share = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = rows.withColumn("slice", share("id", slices)).withColumn("block", every(blocks))
        asked = asked.withColumn("block", share("query_id", blocks)).withColumn("slice", every(slices))
        found = dealt.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block")).applyInPandas(lambda left, right: meet(left, right, k, floor), kinds)
    return rank_within(found, ["query_id"], k, [F.desc("sim"), F.asc("id")])


def meet(rows: pd.DataFrame, asked: pd.DataFrame, k: int, floor: float) -> pd.DataFrame:
    """The best of some rows for some queries, if there are any of both."""
    if not len(rows) or not len(asked):
        return pd.DataFrame({"query_id": [], "id": [], "sim": []}, dtype=object)  # numbers would be no ids of text
    return best(asked, _stack(asked["v"]), rows, k, floor)


def best(asked: pd.DataFrame, matrix: np.ndarray, rows: pd.DataFrame, k: int, floor: float, tile: int = 1024) -> pd.DataFrame:
    """The k best of ``rows`` for each query; of those that tie with the k-th the smallest ids, for the ranking to come.

    ``tile`` queries and rows are multiplied at a time.
    """
    qids, ids, v = asked["query_id"].to_numpy(), rows["id"].to_numpy(), _stack(rows["v"])
    owned, mine = rows["o"].notna().any(), rows["o"].to_numpy()
    found = []
    for a in range(0, len(qids), tile):
        for b in range(0, len(ids), 16 * tile):
            part = slice(b, b + 16 * tile)
            sims = np.round(np.clip(matrix[a : a + tile] @ v[part].T, 0, 1), DIGITS)
            if owned:
                sims[asked["o"].to_numpy()[a : a + tile][:, None] == mine[part][None, :]] = -1.0
            on = sims >= max(floor, 0.0)
            if sims.shape[1] > k:
                kth = np.partition(sims, -k, 1)[:, -k][:, None]
                on &= sims >= kth
                # of ties at the k-th only the smallest ids can be ranked
                for i in np.flatnonzero(on.sum(1) > 4 * k):
                    tied = np.flatnonzero(on[i] & (sims[i] == kth[i]))
                    on[i, tied[np.argsort(ids[part][tied], kind="stable")[k:]]] = False
            i, j = np.nonzero(on)
            found.append(pd.DataFrame({"query_id": qids[a + i], "id": ids[b + j], "sim": sims[i, j]}))
    return pd.concat(found, ignore_index=True)


def as_matrix(lists: pa.Array) -> np.ndarray:
    """A row for each list of numbers; all have one length, and none is null."""
    if lists.null_count:
        raise ValueError("a vector is null")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def as_bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def owner_codes(rows: pa.ChunkedArray, asked: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal for equal owners; those without an owner are equal to none."""
    codes = pa.chunked_array([*rows.chunks, *asked.cast(rows.type).chunks], rows.type).combine_chunks().dictionary_encode().indices
    codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
    own, other = codes[: len(rows)], codes[len(rows) :]
    return own, np.where(other < 0, -2, other)


def search_all(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.0, owner: str | None = None, block_bytes: int = 32 << 20, least: int = 1024) -> DataFrame:
    """``query_id, id, sim, rank`` as ``search_batch`` gives them, for about as many queries as rows: every row against every query.

    Queries are dealt into blocks and rows into slices by a hash, each of about ``block_bytes`` at most, and every block meets every
    slice once. There are three such meetings or more for each core unless pieces fall below ``least`` rows. Vectors of floats are
    sent as four bytes a number, others as eight. Ids are of any type that has an order, structs included.
    """
    own = F.col(owner) if owner else F.lit(None).cast("long")
    short = vectors.schema["vector"].dataType.simpleString() == queries.schema["vector"].dataType.simpleString() == "array<float>"
    number = "float" if short else "double"
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked_n = queries.count()
    most = max(1, block_bytes // ((4 if short else 8) * max(1, width or 1)))
    blocks, slices = max(1, -(-asked_n // most)), max(1, -(-n // most))
    meetings = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    while blocks * slices < meetings and max(asked_n / blocks, n / slices) > least:
        if asked_n / blocks > n / slices:
            blocks += 1
        else:
            slices += 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("o"), as_bytes(as_matrix(batch.column("v")))], names=["key", "o", "x"])

    def packed(df: DataFrame, key: str) -> DataFrame:
        work = df.select(F.col(key).alias("key"), own.alias("o"), F.col("vector").cast(f"array<{number}>").alias("v"))
        kinds = ", ".join(f"{c} {work.schema[c].dataType.simpleString()}" for c in ("key", "o")) + ", x binary"
        return work.mapInArrow(pack, kinds)

    share = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = packed(vectors, "id").withColumn("slice", share(slices)).withColumn("block", every(blocks))
    asked = packed(queries, "query_id").withColumn("block", share(blocks)).withColumn("slice", every(slices))
    kinds = f"query_id {asked.schema['key'].dataType.simpleString()}, id {rows.schema['key'].dataType.simpleString()}, sim double"
    place = ["slice", "block"]
    found = rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(lambda left, right: meet_all(left, right, k, floor, np.float32 if short else np.float64), kinds)
    return rank_within(found, ["query_id"], k, [F.desc("sim"), F.asc("id")])


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix whose rows ``as_bytes`` made binaries, without a Python object for each of them."""
    parts = []
    for c in column.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)
        parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[c.offset] : ends[c.offset + len(c)]])
    return np.concatenate(parts).view(kind).reshape(len(column), -1)


def meet_all(rows: pa.Table, asked: pa.Table, k: int, floor: float, kind: type = np.float64, tile: int = 1024) -> pa.Table:
    """The k best of ``rows`` for each query of ``asked(key, o, x)``; ties go to the smaller ids.

    ``tile`` queries and four times as many rows are multiplied at a time, at first in four bytes a number. What is below a query's k-th
    best so far by more than the error this can have is out; all else is worked out in eight bytes, which alone decides.
    """
    names = ["query_id", "id", "sim"]
    if not len(rows) or not len(asked) or k <= 0:
        return pa.table([asked.column("key").slice(0, 0), rows.column("key").slice(0, 0), pa.array([], pa.float64())], names=names)
    order = pa.table({"key": rows.column("key")})
    while any(pa.types.is_struct(f.type) for f in order.schema):
        order = order.flatten()
    order = pc.sort_indices(order, [(c, "ascending") for c in order.column_names])
    v, q = _numbers(rows.column("x"), kind)[order.to_numpy()], _numbers(asked.column("x"), kind)
    rows = rows.select(["key", "o"]).take(order)  # places are in the order of ids
    mine, other = owner_codes(rows.column("o"), asked.column("o"))
    k, low, step = min(k, len(rows)), max(floor, 0.0), 4 * tile
    v_short = v.astype(np.float32, copy=False)
    longest = np.sqrt(max(np.einsum("ij,ij->i", x, x, dtype=np.float64).max() for x in (v[b : b + step] for b in range(0, len(v), step))))
    whole = lambda x: x.astype(np.float64, copy=False)
    out = []
    for a in range(0, len(q), tile):
        w = slice(a, a + tile)
        x, x_short, owned = whole(q[w]), q[w].astype(np.float32, copy=False), other[w]
        n = len(x)
        # each number and each sum is off by a rounding of 2^-24 at most, and so is the bound
        slack = np.sqrt(np.einsum("ij,ij->i", x, x)) * longest * (x.shape[1] + 8) * 2.0**-23 + 2.0**-22 + 10.0**-DIGITS
        trusted = bool(np.isfinite(slack).all()) and slack.max() < 1
        sim, at = np.full((n, k), -1.0), np.full((n, k), -1)
        for b in range(0, len(v), step):
            r = slice(b, b + step)
            full = at[:, -1] >= 0
            need = np.where(full, sim[:, -1], low)
            i = j = None
            if trusted:
                # where 0 is enough, so are negative ones
                on = x_short @ v_short[r].T >= np.where((need <= 0) & ~full, -np.inf, need - slack).astype(np.float32)[:, None]
                many = np.count_nonzero(on)
                if not many:
                    continue
                if many * x.shape[1] <= 4 << 20:  # few enough to be taken one by one
                    i, j = np.divmod(np.flatnonzero(on), on.shape[1])
                    new = np.round(np.clip(np.einsum("ij,ij->i", x[i], whole(v[b + j])), 0, 1), DIGITS)
                    # rows come in the order of ids, so one that ties with the k-th is behind it
                    keep = (owned[i] != mine[b + j]) & np.where(full[i], new > need[i], new >= low)
                    i, j, new = i[keep], j[keep], new[keep]
            if i is None:
                s = np.round(np.clip(x @ whole(v[r]).T, 0, 1), DIGITS)
                s[owned[:, None] == mine[r][None, :]] = -1.0
                on = np.where(full[:, None], s > need[:, None], s >= low)
                for m in np.flatnonzero(on.sum(1) > 4 * k):
                    kth = np.partition(s[m], len(s[m]) - k)[len(s[m]) - k]
                    on[m] &= s[m] >= kth
                    tied = np.flatnonzero(on[m] & (s[m] == kth))
                    on[m, tied[k:]] = False
                i, j = np.nonzero(on)
                new = s[i, j]
            if not len(i):
                continue
            better = np.unique(i)
            had, place = np.nonzero(at[better] >= 0)
            had = better[had]
            i, p, new = np.concatenate([i, had]), np.concatenate([b + j, at[had, place]]), np.concatenate([new, sim[had, place]])
            by = np.lexsort((p, -new, i))
            i, p, new = i[by], p[by], new[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
            top = rank < k
            sim[i[top], rank[top]], at[i[top], rank[top]] = new[top], p[top]
        i, place = np.nonzero(at >= 0)
        out.append((a + i, at[i, place], sim[i, place]))
    i, p, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([asked.column("key").take(pa.array(i)), rows.column("key").take(pa.array(p)), pa.array(s)], names=names)


def floor_filter(vectors: DataFrame, query: list[float], floor: float, id: str = "id", vector: str = "vector") -> DataFrame:
    """``id, sim`` of the rows whose similarity to the query (negative ones count 0) is at least ``floor``."""
    sims = vectors.select(id, F.round(F.greatest(F.lit(0.0), dot(vector, F.array(*map(F.lit, query)))), DIGITS).alias("sim"))
    return sims.filter(F.col("sim") >= floor)


def get_vectors(vectors: DataFrame, wanted: DataFrame, strict: bool = True, id: str = "id") -> DataFrame:
    """The vectors of ``wanted(id, ord)`` in its order; an unknown id is an error if ``strict``."""
    found = wanted.join(vectors, id, "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.concat(F.lit("unknown id "), F.col(id).cast("string")))
        found = found.withColumn("vector", F.when(F.col("vector").isNull(), missing).otherwise(F.col("vector")))
    return found.orderBy("ord")
