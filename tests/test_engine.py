"""Cells, communities, traversal order, providers, commands and sources against brute force or by hand."""

import itertools
import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatgraph import cli
from heatgraph.checkpoints import checkpoint_folder
from heatgraph.errors import ConfigError, HeatgraphError, ProviderError
from heatgraph.functions import blanks, chunking, providers, vectors
from heatgraph.operators import cells, communities, edges, expansion, knn, traversal
from heatgraph.plans.config import Config
from heatgraph.plans.index import build
from heatgraph.plans.query import Options, run_query
from heatgraph.sources import corpus
from heatgraph.sources.snapshots import Snapshots


@pytest.fixture(scope="module")
def clustered(spark):
    """600 unit vectors around 30 centres, and a third as many copies of one of them."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 16))
    x = centres[draw.integers(0, 30, 600)] + 0.6 * draw.normal(size=(600, 16))
    x = np.concatenate([x, np.repeat(x[:1], 200, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()


def test_cells_reach_their_recall(spark, clustered):
    found = cells.fit_cells(clustered, 8, 0.95, sample_bytes=4 * 16 * 300)
    assert 0.95 <= found.recall <= 1 and found.probes < len(found.centres) <= 28
    queries = clustered.select(F.col("id").alias("query_id"), "id", "vector")
    exact = {(r["query_id"], r["id"]): r["sim"] for r in knn.search_batch(clustered, queries, 8, owner="id").collect()}
    near = {(r["query_id"], r["id"]): r["sim"] for r in cells.search_cells(clustered, queries, found, 8, owner="id", slice_rows=50, block=70).collect()}
    assert len(near.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(near[k] - exact[k]) < 1e-9 for k in near.keys() & exact.keys())
    # with all cells looked at, in slices and blocks, nothing is missing
    every = cells.Cells(found.centres, len(found.centres), 1.0)
    again = {(r["query_id"], r["id"]) for r in cells.search_cells(clustered, queries, every, 8, owner="id", slice_rows=50, block=70).collect()}
    assert again == exact.keys()
    lists = edges.knn_edges(clustered, None, 8, 0.3, exact_rows=100).count()
    assert lists >= 0.9 * edges.knn_edges(clustered, None, 8, 0.3).count()
    none = clustered.limit(0)
    assert cells.search_cells(none, queries, cells.fit_cells(none), 3).count() == 0


def test_own_parts_are_left_out_before_the_best_are_taken(spark):
    rows = [(0, i, [1.0, 0.01 * i]) for i in range(50)] + [(1, 0, [1.0, 0.2]), (2, 0, [0.6, 0.8])]
    subs = spark.createDataFrame(rows, "chunk_id long, ord int, vector array<double>").select("chunk_id", "ord", vectors.l2_normalize("vector").alias("vector"))
    whole = subs.groupBy(F.col("chunk_id").alias("id")).agg(F.first("vector").alias("vector"))
    found = {(r["src"], r["dst"]) for r in edges.subchunk_edges(subs, whole, None, 1, 0.1, near_dup=2.0).collect()}
    assert {(0, 1), (1, 0)} <= found


def modularity(links, label, resolution=1.0):
    total = 2 * sum(w for _, _, w in links)
    strength, inside = defaultdict(float), defaultdict(float)
    for a, b, w in links:
        strength[label[a]] += w
        strength[label[b]] += w
        inside[label[a]] += 2 * w * (label[a] == label[b])
    return sum(inside[c] / total - resolution * (strength[c] / total) ** 2 for c in strength)


def best_modularity(links, nodes):
    best = -1.0
    for label in itertools.product(range(4), repeat=len(nodes) - 1):
        best = max(best, modularity(links, dict(zip(nodes, (0, *label), strict=True))))
    return best


def test_communities_are_near_the_best_partition(spark):
    draw = random.Random(2)
    for _ in range(4):
        nodes = list(range(8))
        links = [(a, b, round(draw.uniform(0.2, 1), 3)) for a, b in itertools.combinations(nodes, 2) if draw.random() < (0.8 if a % 2 == b % 2 else 0.15)]
        nodes = sorted({n for a, b, _ in links for n in (a, b)})
        label = communities.partition(links, 2 * sum(w for *_, w in links))
        assert modularity(links, label) >= best_modularity(links, nodes) - 0.02


def test_large_components_are_coarsened(spark):
    draw = random.Random(7)
    links = {(a, b): round(draw.uniform(0.5, 1), 3) for g in range(12) for a, b in itertools.combinations(range(10 * g, 10 * g + 10), 2) if draw.random() < 0.7}
    links |= {(10 * g + 9, (10 * g + 10) % 120): 0.2 for g in range(12)}
    rows = [(min(k), max(k), w) for k, w in links.items()]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    scores = []
    for most in (10_000, 60):
        found = communities.communities(df, most_edges=most).collect()
        label = {r["chunk_id"]: r["community_id"] for r in found}
        assert len(found) == len(label) == 120
        firsts = [min(n for n, c in label.items() if c == k) for k in range(max(label.values()) + 1)]
        assert firsts == sorted(firsts)
        scores.append(modularity(rows, label))
    assert scores[1] >= 0.9 * scores[0] and scores[0] > 0.8
    # what nothing can be gained from stays as it is
    assert communities.communities(df, resolution=1e6, most_edges=10).select("community_id").distinct().count() == 120
    assert communities.communities(df.limit(0)).count() == 0


def test_heat_in_order_by_hand(spark):
    draw = random.Random(5)
    nodes = range(40)
    links = [(a, b, round(draw.uniform(0.3, 1), 2)) for a, b in itertools.combinations(nodes, 2) if draw.random() < 0.12]
    seeds = [(q, n, round(draw.uniform(0.1, 1), 2)) for q in (1, 2) for n in draw.sample(nodes, 4)]
    sims = [(q, n, round(draw.random(), 2)) for q in (1, 2) for n in nodes]
    near = defaultdict(dict)
    for a, b, w in links:
        near[a][b] = near[b][a] = w
    want = {}
    for q in (1, 2):
        warm = {n for i, n, s in sims if i == q and s >= 0.3} | {n for i, n, _ in seeds if i == q}
        state = {n: (h, n, None, 0.0, 0) for i, n, h in seeds if i == q}
        turn = sorted(state)
        for hop in (1, 2, 3):
            hotter = {}
            for u in turn:
                for v in near[u].keys() & warm:
                    given = state[u][0] * near[u][v] * 0.5
                    if given > state.get(v, (-1,))[0]:
                        state[v] = hotter[v] = (given, state[u][1], u, near[u][v], hop)
            turn = sorted(hotter, key=lambda n: (-state[n][0], n))[:6]
        want |= {(q, n): s for n, s in state.items()}
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    given = frame(seeds, "query_id long, id long, heat double")
    table, graph = frame(sims, "query_id long, id long, sim double"), frame(links, "src long, dst long, weight double")
    asked = []

    def on_demand(wanted):
        asked.append(wanted.count())
        return wanted.join(table, ["query_id", "id"])

    for source in (table, on_demand):
        found = traversal.heat_in_order(given, graph, source, 3, 0.5, 0.3, 6).collect()
        assert {(r["query_id"], r["id"]): (r["heat"], r["seed"], r["parent"], r["edge_weight"], r["hop"]) for r in found} == want
    assert 0 < sum(asked[:1]) < 80


def test_small_parts_join(spark):
    join = lambda parts: chunking.join_small(parts, lambda p: len(p) < 3, lambda a, b: a + b)
    assert join(["a", "bcd", "e", "f", "ghi", "j"]) == ["abcdef", "ghij"]
    assert join(["a", "b", "c"]) == ["abc"] and join(["abc", "d"]) == ["abcd"] and join([]) == [] and join(["ab"]) == ["ab"]
    assert join(["a", "b", "cde"]) == ["abcde"] and join(["ab", "c", "def", "ghi"]) == ["abc", "def", "ghi"]


def test_white_space_of_all_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("\t a b\n\u3000",), (" \r\n\t",), ("",), (None,)], "t string")
    found = rows.select(blanks.strip("t").alias("s"), blanks.is_blank("t").alias("b")).collect()
    assert [tuple(r) for r in found] == [("a b", False), ("", True), ("", True), (None, None)]
    with pytest.raises(Exception, match="blank query"):
        run_query(Snapshots(spark, str(tmp_path)).tables(), spark.createDataFrame([(1, "\t\n")], "query_id long, query string")).collect()
    (tmp_path / "labels.jsonl").write_text('{"query": "x", "relevant_files": []}\n\t\r\n{"query": "y", "relevant_files": ["a"]}\n')
    assert [r["query_id"] for r in corpus.labelled_queries(spark, str(tmp_path / "labels.jsonl")).collect()] == [1, 3]
    raw = '{"queries": ["\\t one\\n", "\\n", "q"], "hyde": "\\t"}'
    (r,) = expansion.expand(spark.createDataFrame([(1, " q\t", raw)], "query_id long, query string, raw string")).collect()
    assert r["variants"] == ["one"] and r["hyde"] is None


def test_hidden_files_have_no_cap(spark, tmp_path, monkeypatch):
    (tmp_path / "pkg").mkdir()
    for i in range(1001):
        (tmp_path / "pkg" / f"_{i}.py").write_text(f"x = {i}\n")
    (tmp_path / ".gitignore").write_text("_7.py\n")
    monkeypatch.setattr(corpus, "HIDDEN_BATCH", 3000)
    found = corpus.scan_folder(spark, str(tmp_path))
    assert found.count() == 1001 and found.filter("path = 'pkg/_12.py'").first()["text"] == "x = 12\n"
    (tmp_path / "none").mkdir()
    assert corpus.scan_folder(spark, str(tmp_path / "none")).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    assert checkpoint_folder("s3a://b/c", "yarn") == "s3a://b/c" and checkpoint_folder(None, "local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ConfigError):
            checkpoint_folder(None, master)


def test_keys_and_addresses(monkeypatch):
    monkeypatch.delenv("MY_KEY", raising=False)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    settings = {"provider": "http", "url": "http://h/v1/", "model": "m", "key_variable": "MY_KEY"}
    for kind in ("embedder", "generator", "reranker"):
        with pytest.raises(ProviderError, match="MY_KEY"):
            providers.make(kind, settings)
    monkeypatch.setenv("MY_KEY", "k")
    asked = []
    monkeypatch.setattr(providers, "post", lambda url, body, key=None, timeout=0: asked.append((url, body, key)) or {"results": [{"index": 1, "relevance_score": 2}], "choices": [{"message": {"content": "yes"}}]})
    assert providers.make("reranker", settings).score("q", ["a", "b", "c"]) == [0.0, 2.0, 0.0]
    assert asked[-1] == ("http://h/v1/rerank", {"model": "m", "query": "q", "documents": ["a", "b", "c"]}, "k")
    assert providers.make("generator", settings).generate("s", "p", max_tokens=5) == "yes"
    assert asked[-1][1] == {"model": "m", "temperature": 0.3, "max_tokens": 5, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}]}
    assert providers.make("reranker", settings).score("q", []) == []
    bare = {"provider": "http", "model": "m", "url": ""}
    monkeypatch.delenv("OPENAI_BASE_URL", raising=False)
    with pytest.raises(ProviderError, match="url"):
        providers.make("embedder", bare)
    monkeypatch.setenv("OPENAI_BASE_URL", "http://other/v1")
    assert providers.make("embedder", bare).url == "http://other/v1" and providers.secret("") is None


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    from heatgraph.plans.index import run_index

    root = tmp_path_factory.mktemp("project")
    (root / "heatgraph.toml").write_text("[graph]\nmin_edge_sim = 0.05\nquery_floor = 0.0\n")
    for name, text in {"a.md": "dogs and cats live with people", "b.md": "dogs and people live in houses", "c.md": "rockets fly to the moon with people", "empty.md": " \n"}.items():
        (root / name).write_text(text)
    config = Config().set("graph.min_edge_sim", 0.05).set("graph.query_floor", 0.0)
    run_index(Snapshots(spark, str(root / ".heatgraph")), corpus.scan_folder(spark, str(root), ["*.md"]), config)
    return root


def test_inspect_commands(spark, project, monkeypatch, capsys):
    monkeypatch.chdir(project)

    def run(*argv):
        capsys.readouterr()
        code = cli.main(["inspect", *argv])
        out = capsys.readouterr().out.strip()
        return code, json.loads(out) if out else None

    code, file = run("file", "a.md")
    assert code == 0 and file["chunk_count"] == 1 and file["chunks"][0]["preview"].startswith("dogs")
    chunk = str(file["chunks"][0]["id"])
    code, doc = run("chunk", chunk)
    assert code == 0 and doc["file"] == "a.md" and doc["edges"] and doc["text"].startswith("dogs")
    code, near = run("neighbors", chunk)
    assert code == 0 and near["neighbors"] == doc["edges"]
    weights = [n["weight"] for n in near["neighbors"]]
    assert weights == sorted(weights, reverse=True)
    code, every = run("communities")
    assert code == 0 and every["count"] == len(every["communities"]) >= 1
    first = every["communities"][0]
    code, one = run("community", str(first["community_id"]))
    assert code == 0 and one["size"] == first["size"] == len(one["members"])
    assert run("file", "empty.md")[0] == 1
    for argv in (("chunk", "99999"), ("neighbors", "99999"), ("file", "what.md"), ("community", "999")):
        assert run(*argv)[0] == 2


def test_reranking_is_off_without_a_reranker(spark, project):
    tables = Snapshots(spark, str(project / ".heatgraph")).tables()
    queries = spark.createDataFrame([(1, "people live with dogs")], "query_id long, query string")
    order = lambda **kw: [(r["id"], r["score"], r["rerank"]) for r in run_query(tables, queries, Config(), Options(**kw)).orderBy("rank").collect()]
    assert order(rerank=True) == order()
    found = run_query(tables, queries, Config(), Options(rerank=True), reranker=providers.WordReranker()).orderBy("rank").collect()
    assert {r["file"]: r["rerank"] for r in found}["a.md"] == 1.0


def test_missing_subchunks_are_an_error(spark, project):
    config = Config().set("graph.edge_source", "subchunk")
    tables = Snapshots(spark, str(project / ".heatgraph")).tables()
    files = spark.createDataFrame([("new.md", "h", 0.0, "some new text about dogs")], "path string, content_hash string, mtime double, text string")
    with pytest.raises(HeatgraphError, match="sub-chunk"):
        build(tables, corpus.scan_folder(spark, str(project), ["*.md"]).unionByName(files), config, highest=100)


def test_batches_of_files_are_indexed(spark, tmp_path):
    from heatgraph.streaming.incremental import index_stream

    ddl = "path string, content_hash string, mtime double, text string"
    store, source = Snapshots(spark, str(tmp_path / "index")), str(tmp_path / "in")
    batches = [
        [("a.md", "1", 1.0, "dogs bark at night"), ("a.md", "0", 0.5, "older"), ("b.md", "1", 1.0, "cats sleep all day")],
        [("a.md", "2", 2.0, "dogs bark at cats"), ("c.md", "1", 2.0, "birds sing")],
        [("b.md", "-", 3.0, None)],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(ddl).parquet(source), store, str(tmp_path / "checkpoint"), Config().set("graph.min_edge_sim", 0.05)).awaitTermination()
        seen.append({r["file_path"]: (r["id"], r["text"]) for r in store.table("chunks").collect()})
    assert {p: t for p, (_, t) in seen[0].items()} == {"a.md": "dogs bark at night", "b.md": "cats sleep all day"}
    assert seen[1]["b.md"] == seen[0]["b.md"] and seen[1]["a.md"][1] == "dogs bark at cats" and set(seen[2]) == {"a.md", "c.md"}
    assert seen[2]["c.md"] == seen[1]["c.md"]


def test_cells_bring_no_sample_to_the_driver_as_lists(spark, clustered, monkeypatch):
    """A sample of 64 MB in four bytes a number took over 1.5 GB as rows of Python numbers."""
    kind, sizes = type(clustered), []
    plain = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: [sizes.append(len(out := plain(self))), out][1])
    cells.fit_cells(clustered, 8, asked=20)
    assert max(sizes) <= 20


def test_cells_send_a_query_once_to_each_group(spark, clustered, monkeypatch):
    found = cells.fit_cells(clustered, 8)
    n = clustered.count()
    met, kind = [], type(clustered.groupBy("id"))
    plain = kind.cogroup
    monkeypatch.setattr(kind, "cogroup", lambda self, other: [met.append(other._df.count()), plain(self, other)][1])
    queries = clustered.select(F.col("id").alias("query_id"), "id", "vector")
    every = cells.Cells(found.centres, len(found.centres), 1.0)
    got = cells.search_cells(clustered, queries, every, 8, owner="id", slice_rows=n)
    assert met == [n]  # all cells are one group
    exact = knn.search_batch(clustered, queries, 8, owner="id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_cells_rank_copies_by_id(spark):
    """Names as ids, many equal vectors, owners of several rows, groups of a few cells and cells in slices."""
    rows = [(f"n{i:03d}", i % 7, [1.0, 0.0, 0.0] if i % 3 else [0.6, 0.8 * (-1) ** i, 0.0]) for i in range(240)] + [("zero", 1, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, o int, vector array<double>")
    queries = v.select(F.col("id").alias("query_id"), F.col("o").cast("long").alias("o"), "vector")
    every = cells.Cells(np.eye(3, dtype=np.float32), 3, 1.0)
    for owner in (None, "o"):
        exact = sorted(map(tuple, knn.search_batch(v, queries, 5, 0.5, owner=owner).collect()))
        for slice_rows in (30, 300):
            got = cells.search_cells(v, queries, every, 5, 0.5, owner=owner, slice_rows=slice_rows, block=50)
            assert sorted(map(tuple, got.collect())) == exact



def _brute(rows, k, floor):
    """By the definition: names in order, cosines at nine digits, the owner's own rows left out."""
    x = np.array([v for *_, v in rows])
    sims = np.round(np.clip(x @ x.T, 0, 1), 9)
    want = {}
    for i, (a, own, _) in enumerate(rows):
        near = sorted((-sims[i, j], b) for j, (b, other, _) in enumerate(rows) if own is None or other != own)
        want |= {(a, b, r): -s for r, (s, b) in enumerate(near[:k], 1) if -s >= floor}
    return want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_all_is_exact(spark, kind):
    """Copies beyond k, an owner with many rows, rows without an owner, zeros, long vectors; in one meeting and in many."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(500, 8))
    x[100:180] = x[100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:203] = 0
    x[300:303] *= 1e6
    x = x.astype(np.float32 if kind == "float" else np.float64).tolist()
    rows = [((i // 3, i % 3), None if i % 50 == 7 else 1 if i > 400 else i // 3, v) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, f"id struct<a:long,b:int>, o long, vector array<{kind}>")
    queries = v.select(F.col("id").alias("query_id"), "o", "vector")
    for k, floor in ((3, 0.0), (20, 0.6)):
        want = _brute(rows, k, floor)
        for size, least in ((64 << 20, 10_000), (8 * 8 * 90, 50)):
            got = {(tuple(r["query_id"]), tuple(r["id"]), r["rank"]): r["sim"] for r in knn.search_all(v, queries, k, floor, "o", size, least).collect()}
            assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 2e-9 for e in want)


def test_search_all_keeps_what_four_bytes_cannot_tell(spark):
    """Cosines that differ in the eighth digit and later are ranked by eight bytes, tile after tile."""
    turn = 0.5 + 2e-8 * np.random.default_rng(2).permutation(3000)
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    want = sorted((-round(float(np.cos(t)), 9), i) for i, t in enumerate(turn))[:9]
    got = knn.search_all(v, query, 9).orderBy("rank").collect()
    assert [(-r["sim"], r["id"]) for r in got] == want


def test_search_all_of_nothing(spark, clustered):
    queries = clustered.select(F.col("id").alias("query_id"), "id", "vector")
    for rows, asked in ((clustered.limit(0), queries), (clustered, queries.limit(0))):
        assert knn.search_all(rows, asked, 3, owner="id").count() == 0


def test_subchunk_ties_go_by_number(spark):
    """More copies than twice k: by the text of their names, chunk 10 came before chunk 2."""
    subs = spark.createDataFrame([(c, o, [1.0, 0.0]) for c in range(1, 31) for o in (9, 10)], "chunk_id long, ord int, vector array<double>")
    whole = spark.createDataFrame([(c, [0.0, 0.0]) for c in range(1, 31)], "id long, vector array<double>")
    found = {(r["src"], r["dst"]) for r in edges.subchunk_edges(subs, whole, None, 3, 0.5).collect()}
    assert found == {(c, d) for c in range(1, 31) for d in ([2, 3] if c == 1 else [1, 3] if c == 2 else [1, 2])}


def test_subchunk_edges_are_exact_beyond_200_000_parts(spark):
    """Beyond that size the lists came from cells and missed one row in twenty."""
    x = np.random.default_rng(8).normal(size=(200_400, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    flat = pa.array(x.ravel())
    table = pa.table({"id": pa.array(np.arange(len(x))), "vector": pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float32()))})
    subs = spark.createDataFrame(table).select(F.expr("id div 4").alias("chunk_id"), (F.col("id") % 4).cast("int").alias("ord"), "vector")
    asked = range(0, 50_100, 501)
    sources = spark.createDataFrame([(c,) for c in asked], "id long")
    whole = subs.select(F.col("chunk_id").alias("id")).distinct().withColumn("vector", F.array(F.lit(0.0)))
    found = {(r["src"], r["dst"]): r["weight"] for r in edges.subchunk_edges(subs, whole, sources, 8, 0.3).collect()}
    want = {}
    for c in asked:
        for p in range(4 * c, 4 * c + 4):
            s = np.round(np.clip(x.astype(np.float64) @ x[p].astype(np.float64), 0, 1), 9)
            s[4 * c : 4 * c + 4] = -1
            for i in np.lexsort((np.arange(len(s)), -s))[:8]:
                want[c, i // 4] = max(s[i], want.get((c, i // 4), 0))
    assert found.keys() == want.keys() and all(abs(found[e] - want[e]) < 2e-9 for e in want)
