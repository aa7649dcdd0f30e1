"""Communities of the similarity graph by modularity, and their relational reports."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.checkpoints import cut
from heatgraph.operators.components import connected_components
from heatgraph.operators.maintenance import assign_ids

Graph = dict[int, dict[int, float]]


def _move(graph: Graph, own: dict[int, float], label: dict[int, int], total: float, resolution: float, order: list[int], inside: dict[int, int] | None = None) -> None:
    """Moves nodes to the neighbouring label with the highest gain until none gains. ``inside`` confines moves to a group."""
    weight: dict[int, float] = defaultdict(float)
    for v, c in label.items():
        weight[c] += own[v]
    queue, queued = deque(order), set(order)
    while queue:
        v = queue.popleft()
        queued.discard(v)
        near: dict[int, float] = defaultdict(float)
        for u, w in graph[v].items():
            if u != v and (inside is None or inside[u] == inside[v]):
                near[label[u]] += w
        here = label[v]
        weight[here] -= own[v]
        gain = lambda c: near.get(c, 0.0) - resolution * own[v] * weight[c] / total  # noqa: B023, E731
        best = min(near, key=lambda c: (-gain(c), c), default=here)
        if gain(best) > gain(here) + 1e-12:
            label[v] = best
            for u in graph[v]:
                if label[u] != best and u not in queued:
                    queue.append(u)
                    queued.add(u)
        weight[label[v]] += own[v]


def partition(edges: list[tuple[int, int, float]], total: float, resolution: float = 1.0, seed: int = 42) -> dict[int, int]:
    """A label for each node of ``edges``: local moves, a refinement inside each group, and the same on the merged graph.

    ``total`` is twice the weight of the whole graph, which may be larger than these edges. The result depends on the set
    of edges and the seed alone.
    """
    graph: Graph = defaultdict(dict)
    for a, b, w in sorted(edges):
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:  # a loop stands for what was merged into a node
            graph[b][a] = graph[a][b]
    members = {v: [v] for v in graph}
    start: dict[int, int] | None = None
    draw = random.Random(seed)
    while True:
        own = {v: sum(w * (2 if u == v else 1) for u, w in near.items()) for v, near in graph.items()}
        order = sorted(graph)
        draw.shuffle(order)
        label = dict(start) if start else {v: v for v in graph}
        _move(graph, own, label, total, resolution, order)
        fine = {v: v for v in graph}
        _move(graph, own, fine, total, resolution, order, inside=label)
        groups: dict[int, list[int]] = defaultdict(list)
        for v in sorted(graph):
            groups[fine[v]].append(v)
        if len(groups) == len(graph):
            break
        name = {v: min(vs) for vs in groups.values() for v in vs}
        merged: Graph = defaultdict(dict)
        for v, near in graph.items():
            merged[name[v]]
            for u, w in near.items():
                if u >= v:  # each edge once; inside a group it becomes a loop
                    a, b = sorted((name[u], name[v]))
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[a][b]
        start = {}
        first: dict[int, int] = {}
        for g in sorted(merged):
            start[g] = first.setdefault(label[g], g)
        members = {g: [m for v in groups[fine[g]] for m in members[v]] for g in merged}
        graph = merged
    return {m: label[v] for v, ms in members.items() for m in ms}


def _merged(edges: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """``node, into``: nodes that go into the neighbour with the highest gain in modularity, if that gain is positive.

    By a hash of the node and ``turn`` half of the nodes may go and half may receive, so merges are stars.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))  # a loop counts twice
    strength = both.groupBy("src").agg(F.sum("weight").alias("s"))
    pairs = both.filter("src <> dst").join(strength, "src").join(strength.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst")
    gain = F.col("weight") - F.lit(resolution) * F.col("s") * F.col("t") / F.lit(total)
    best = pairs.withColumn("gain", F.round(gain, 12)).filter("gain > 0").groupBy("src").agg(F.max_by("dst", F.struct("gain", -F.col("dst"))).alias("into"))
    goes = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
    return best.filter(goes("src") & ~goes("into")).select(F.col("src").alias("node"), "into")


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42, most_edges: int = 1_000_000) -> DataFrame:
    """``chunk_id, community_id``: numbers from 0 in order of the smallest member; nodes without edges are absent.

    Components are found by joins and partitioned side by side, each with the weight of the whole graph in its gains, as
    they affect each other through it alone. While a component has more than ``most_edges`` edges, it is made
    coarser first, by joins: nodes go into the neighbour they gain most with, and edges between what has merged are added up.
    So no task gets more than that many; a large component whose nodes gain nothing any more is left as it is.
    """
    total = 2 * float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    comps = cut(connected_components(edges))
    graph = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    graph = cut(graph.join(comps.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "weight"))
    names = comps.select(F.col("node").alias("chunk_id"), F.col("node").alias("now"))
    idle, done = 0, None
    for turn in range(1000):
        large = graph.groupBy("component").count().filter(F.col("count") > most_edges).select("component")
        some = cut(graph.join(large, "component", "left_semi"))
        if some.isEmpty():
            break
        moves = cut(_merged(some, total, resolution, turn))
        if moves.isEmpty():
            idle += 1
            if idle < 8:
                continue
            done = cut(some)
            graph = graph.join(large, "component", "left_anti")
            break
        idle = 0
        to = lambda end: F.coalesce(F.col(f"to_{end}"), F.col(end))
        moved = some.join(moves.select(F.col("node").alias("src"), F.col("into").alias("to_src")), "src", "left").join(moves.select(F.col("node").alias("dst"), F.col("into").alias("to_dst")), "dst", "left")
        moved = moved.select("component", F.least(to("src"), to("dst")).alias("src"), F.greatest(to("src"), to("dst")).alias("dst"), "weight").groupBy("component", "src", "dst").agg(F.sum("weight").alias("weight"))
        graph = cut(graph.join(large, "component", "left_anti").unionByName(moved))
        names = cut(names.join(moves.withColumnRenamed("node", "now"), "now", "left").select("chunk_id", F.coalesce("into", "now").alias("now")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = partition(list(pdf[["src", "dst", "weight"]].itertuples(index=False, name=None)), total, resolution, seed)
        return pd.DataFrame({"now": list(found), "label": [found[v] for v in found]})

    labels = graph.groupBy("component").applyInPandas(run, "now long, label long")
    if done is not None:
        ends = done.select(F.col("src").alias("now")).unionByName(done.select(F.col("dst").alias("now"))).distinct()
        labels = labels.unionByName(ends.select("now", F.col("now").alias("label")))
    labels = cut(names.join(labels, "now").select("chunk_id", "label"))
    least = labels.groupBy("label").agg(F.min("chunk_id").alias("least"))
    number = assign_ids(least, -1, ("least",), "community_id").select("label", F.col("community_id").cast("int").alias("community_id"))
    return labels.join(number, "label").select("chunk_id", "community_id")


def community_sizes(members: DataFrame) -> DataFrame:
    """``community_id, size``, the largest first, ties by number."""
    return members.groupBy("community_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community_id")


def community_preview(members: DataFrame, chunks: DataFrame, files: int = 3) -> DataFrame:
    """``community_id, size, files``: the first distinct files of each community, by their smallest member."""
    rows = members.join(chunks.select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id")
    first = rows.groupBy("community_id", "file_path").agg(F.min("chunk_id").alias("least"))
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy("least"))
    few = first.withColumn("r", rank).filter(F.col("r") <= files)
    names = few.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("least", "file_path"))).alias("fs"))
    sizes = members.groupBy("community_id").agg(F.count("*").alias("size"))
    return sizes.join(names, "community_id", "left").select("community_id", "size", F.transform("fs", lambda x: x["file_path"]).alias("files"))
