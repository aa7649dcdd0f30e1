"""Operators on small inputs with results worked out by hand."""

import random
from hashlib import md5

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatgraph.errors import ConfigError, ManifestError, ProviderError
from heatgraph.functions import chunking, providers, vectors
from heatgraph.operators import communities, edges, evaluation, expansion, knn, maintenance, ranking, traversal
from heatgraph.operators.components import connected_components

VECTORS = [(10, [1.0, 0.0, 0.0]), (11, [0.8, 0.6, 0.0]), (12, [0.6, 0.8, 0.0]), (13, [0.0, 1.0, 0.0]), (14, [-1.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(VECTORS, "id long, vector array<double>")


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_hash_embedder(spark):
    found = vectors.hash_embed(frame(spark, [(1, "Dogs dogs"), (2, None), (3, "  ")], "id long, text string")).collect()
    by = {r["id"]: r["vector"] for r in found}
    assert by[1][41] == 1.0 and sum(by[1]) == 1.0
    assert by[2] == [0.0] * 64 and by[3] == [0.0] * 64


def test_hash_embedder_forgets_words_within_a_text(spark):
    ws = [f"w{i}" for i in range(500_010)]
    n = [0] * 64
    for w in ws:
        n[md5(w.encode()).digest()[-1] % 64] += 1
    found = vectors.hash_embed(frame(spark, [(1, " ".join(ws)), (2, "w1 w1")], "id long, text string").coalesce(1)).collect()
    by = {r["id"]: r["vector"] for r in found}
    norm = sum(x * x for x in n) ** 0.5
    assert by[1] == pytest.approx([x / norm for x in n]) and max(by[2]) == 1.0


def test_unit_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0, None])]
    found = {r["id"]: r["v"] for r in frame(spark, rows, "id long, v array<double>").select("id", vectors.l2_normalize("v").alias("v")).collect()}
    assert found == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [], 4: None, 5: [None, None]}


def test_knn(spark, five):
    found = edges.knn_edges(five, None, 2, 0.5).collect()
    by = {s: [(r["dst"], round(r["weight"], 6)) for r in sorted(found, key=lambda r: r["rank"]) if r["src"] == s] for s, _ in VECTORS}
    assert by[10] == [(11, 0.8), (12, 0.6)]
    assert by[11] == [(12, 0.96), (10, 0.8)]
    assert by[14] == []
    zero = edges.knn_edges(five, five.filter("id = 14"), 8, 0.0).collect()
    assert {(r["dst"], r["weight"]) for r in zero} == {(i, 0.0) for i in (10, 11, 12, 13)}


def test_knn_ties_go_to_smaller_ids(spark):
    same = frame(spark, [(i, [1.0, 0.0]) for i in range(40)], "id long, vector array<double>")
    found = knn.search_batch(same, same.select(F.col("id").alias("query_id"), "vector").filter("id = 5"), 3)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_blocks_of_queries_agree_with_one_block(spark):
    draw = random.Random(4)
    v = frame(spark, [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(120)], "id long, v array<double>").select("id", vectors.l2_normalize("v").alias("vector"))
    q = v.select(F.col("id").alias("query_id"), "vector")
    one, many = (sorted(map(tuple, knn.search_batch(v, q, 5, block=b).collect())) for b in (1000, 17))
    assert one == many and len(one) == 600


@pytest.fixture
def apart(spark):
    """Shuffles whose partitions aren't joined again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["id", "concat('v', id)"])
def test_blocks_meet_every_slice(spark, apart, name):
    draw = random.Random(6)
    v = frame(spark, [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(120)], "id long, v array<double>").select(F.expr(name).alias("id"), F.expr("id div 4").alias("own"), vectors.l2_normalize("v").alias("vector"))
    q = v.select(F.col("id").alias("query_id"), "own", "vector")
    one, many = (sorted(map(tuple, knn.search_batch(v, q, 5, 0.1, owner="own", block=b).collect())) for b in (1000, 17))
    assert one == many and len(one) == 600


def test_sides_without_rows_meet_nothing(spark):
    rows, asked = (pd.DataFrame({k: ["a"], "o": [1], "v": [[1.0]]}) for k in ("id", "query_id"))
    for none in (knn.meet(rows[:0], asked, 3, 0.0), knn.meet(rows, asked[:0], 3, 0.0)):
        for kind in (pa.string(), pa.int64()):
            assert isinstance(pa.Array.from_pandas(none["id"], type=kind), pa.Array) and len(none) == 0


def test_replacement_rule_equals_going_node_by_node(spark):
    draw = random.Random(7)
    for _ in range(3):
        nodes = range(14)
        old = {tuple(sorted(draw.sample(nodes, 2))): draw.random() for _ in range(15)}
        keys = draw.sample(nodes, 8)
        lists = {k: {n: draw.random() for n in draw.sample([x for x in nodes if x != k], 4)} for k in keys}
        want = dict(old)
        for k in keys:
            want = {e: w for e, w in want.items() if k not in e} | {tuple(sorted((k, n))): w for n, w in lists[k].items()}
        found = edges.replace_edges(
            frame(spark, [(*e, w) for e, w in old.items()], "src long, dst long, weight double"),
            frame(spark, [(k, n, w) for k, ns in lists.items() for n, w in ns.items()], "src long, dst long, weight double"),
            frame(spark, [(k, i) for i, k in enumerate(keys)], "id long, ord long"),
        )
        assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == want


def test_subchunk_edges(spark):
    subs = frame(spark, [(10, 0, [1.0, 0.0]), (10, 1, [0.0, 1.0]), (20, 0, [1.0, 0.0]), (30, 0, [0.0, 1.0])], "chunk_id long, ord int, vector array<double>")
    whole = frame(spark, [(10, [0.7071, 0.7071]), (20, [1.0, 0.0]), (30, [0.0, 1.0])], "id long, vector array<double>")
    found = {(r["src"], r["dst"]): r["weight"] for r in edges.subchunk_edges(subs, whole, whole.filter("id = 10"), 1, 0.5).collect()}
    assert found == {(10, 20): 1.0, (10, 30): 1.0}
    assert edges.subchunk_edges(subs, whole, None, 1, 0.5, near_dup=0.5).count() == 0


def test_affected(spark):
    lists = frame(spark, [(1, 2), (1, 3), (2, 1)], "src long, dst long")
    assert [r["id"] for r in edges.affected_ids(lists).collect()] == [3]


def test_rrf(spark):
    rows = [(0, v, d, r) for v, ds in enumerate(([1, 2, 3], [2, 1, 4])) for r, d in enumerate(ds, 1)]
    found = {r["id"]: r["fused"] for r in ranking.rrf(frame(spark, rows, "query_id long, variant int, id long, rank int")).collect()}
    assert found == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 61 + 1 / 62, 3: 1 / 63, 4: 1 / 63})


@pytest.mark.parametrize(("values", "want"), [([0.0, 5.0, 10.0], [0, 0.5, 1]), ([4.0, 4.0], [1, 1]), ([0.0], [1])])
def test_min_max(spark, values, want):
    rows = frame(spark, [(0, i, v) for i, v in enumerate(values)], "query_id long, id long, s double")
    assert [r["x"] for r in rows.select("id", ranking.min_max("s", ["query_id"]).alias("x")).orderBy("id").collect()] == want


def test_combine(spark):
    rows = frame(spark, [(0, 1, 0.0, 1.0, 2.0), (0, 2, 5.0, 1.0, 4.0), (0, 3, 10.0, 1.0, 6.0)], "query_id long, id long, vector double, heat double, rerank double")
    found = ranking.combine(rows, 0.5, 0.3, 0.2, rerank=True).orderBy("id").collect()
    assert [r["score"] for r in found] == pytest.approx([0.3, 0.65, 1.0])
    two = frame(spark, [(0, 1, 0.0, 0.0), (0, 2, 10.0, 10.0)], "query_id long, id long, vector double, heat double")
    assert [r["score"] for r in ranking.combine(two, 0, 0.3, 0.3).orderBy("id").collect()] == [0.0, 1.0]
    assert [r["score"] for r in ranking.combine(two, 1, 0, 0).collect()] == [0.0, 0.0]
    gap = frame(spark, [(0, 1, None, 1.0), (0, 2, 1.0, None)], "query_id long, id long, vector double, heat double")
    assert [r["score"] for r in ranking.combine(gap, 0, 0.5, 0.5).orderBy("id").collect()] == [0.5, 0.5]


def heat(spark, walk, seeds, links, sims=(), **more):
    found = walk(
        frame(spark, [(0, i, h) for i, h in seeds.items()], "query_id long, id long, heat double"),
        frame(spark, links, "src long, dst long, weight double"),
        frame(spark, [(0, i, s) for i, s in {**{n: 1.0 for e in links for n in e[:2]}, **dict(sims)}.items()], "query_id long, id long, sim double"),
        **more,
    )
    return {r["id"]: (round(r["heat"], 9), r["parent"], r["hop"]) for r in found.collect()}


@pytest.mark.parametrize("walk", [traversal.heat_by_hop, traversal.heat_in_order])
def test_heat(spark, walk):
    assert heat(spark, walk, {1: 1.0}, [(1, 2, 0.8), (2, 3, 0.8)], floor=0) == {1: (1.0, None, 0), 2: (0.4, 1, 1), 3: (0.16, 2, 2)}
    assert heat(spark, walk, {1: 1.0, 2: 1.0}, [(1, 3, 0.9), (2, 3, 0.2)], hops=1)[3] == (0.45, 1, 1)
    assert set(heat(spark, walk, {1: 1.0}, [(1, 2, 0.8), (2, 3, 0.8)], {2: 0.1}.items())) == {1}
    capped = heat(spark, walk, {1: 1.0}, [(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.5), (3, 5, 0.9), (4, 6, 0.9)], max_frontier=2)
    assert set(capped) == {1, 2, 3, 4, 5}
    assert heat(spark, walk, {1: 1.0}, [(1, 2, 0.8)], hops=0) == {1: (1.0, None, 0)}


def test_order_within_a_hop_matters(spark):
    """A seed that has just been heated passes its new heat on in the same hop; at once, it doesn't."""
    links, seeds = [(1, 2, 1.0), (2, 3, 1.0)], {1: 1.0, 2: 0.01}
    assert heat(spark, traversal.heat_in_order, seeds, links, hops=1) == {1: (1.0, None, 0), 2: (0.5, 1, 1), 3: (0.25, 2, 1)}
    assert heat(spark, traversal.heat_by_hop, seeds, links, hops=1)[3] == (0.005, 2, 1)


def test_communities(spark):
    links = [(1, 2, 0.95), (2, 3, 0.95), (1, 3, 0.95), (4, 5, 0.95), (5, 6, 0.95), (4, 6, 0.95), (3, 4, 0.05), (20, 21, 0.5)]
    for rows in (links, links[::-1]):
        found = {r["chunk_id"]: r["community_id"] for r in communities.communities(frame(spark, rows, "src long, dst long, weight double")).collect()}
        assert found == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 20: 2, 21: 2}
    assert communities.communities(frame(spark, [], "src long, dst long, weight double")).count() == 0


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    group = {}
    for a, b in links:
        if a is not None and a != b:
            ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
            if ga is not gb:
                ga |= gb
                for n in gb:
                    group[n] = ga
    found = {r["node"]: r["component"] for r in connected_components(frame(spark, links, "src long, dst long").repartition(7)).collect()}
    assert found == {n: min(g) for n, g in group.items()}


def test_maintenance(spark):
    known = frame(spark, [("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    now = frame(spark, [("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r["path"]: r["change"] for r in maintenance.diff(known, now).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert maintenance.drift(known, now).first().asDict() == {"new": 1, "changed": 1, "deleted": 1}
    ids = maintenance.assign_ids(frame(spark, [(f"f{i:03}", p) for i in range(50) for p in range(3)], "file_path string, pos int").repartition(6), 500).orderBy("file_path", "pos")
    assert [r["id"] for r in ids.collect()] == list(range(501, 651))
    old = {"embedding_model": "a", "edge_source": "chunk", "chunk_size_tokens": "800", "chunk_overlap": "0.15", "subchunk_size_tokens": "128"}
    want = {"embedding_model": "a", "edge_source": "chunk", "chunk_size_tokens": 800, "chunk_overlap": 0.15, "subchunk_size_tokens": 64}
    maintenance.check_manifest(old, want)
    maintenance.check_manifest({}, want)
    with pytest.raises(ManifestError):
        maintenance.check_manifest(old, want | {"chunk_size_tokens": 400})
    maintenance.check_manifest(old, want | {"chunk_size_tokens": 400}, full=True)


def test_evaluation(spark):
    ranked = frame(spark, [(q, f, i) for q in (1, 2, 3) for i, f in enumerate("abc", 1)], "query_id long, file string, position int")
    labels = frame(spark, [(1, ["b", "d"]), (2, ["a"]), (3, [])], "query_id long, relevant array<string>")
    found = {r["query_id"]: r for r in evaluation.per_query(ranked, labels).collect()}
    assert (found[1]["recall_5"], found[1]["mrr"], found[1]["hit_ranks"]) == (0.5, 0.5, [2])
    assert (found[2]["recall_5"], found[2]["mrr"], found[3]["recall_5"], found[3]["mrr"]) == (1.0, 1.0, 0.0, 0.0)
    assert {r["query_id"]: r["mrr"] for r in evaluation.per_query(ranked, labels, top=1).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_expansion(spark):
    raws = ['```json\n{"queries": ["", "Q", "one", "ONE", 5, "two", "three", "four"], "hyde": "text"}\n```', "garbage", '{"other": 1}', None, '{"queries": ["x"], "hyde": 7}']
    rows = frame(spark, [(i, "q", r) for i, r in enumerate(raws)], "query_id long, query string, raw string")
    found = {r["query_id"]: (r["variants"], r["hyde"]) for r in expansion.expand(rows).collect()}
    assert found == {0: (["one", "two", "three"], "text"), 1: ([], None), 2: ([], None), 3: ([], None), 4: (["x"], None)}


def test_chunks():
    text = ("zażółć gęślą 漢字 " * 40 + "\n\n") * 3
    parts = chunking.chunk_text(text, "a.txt", 20, 0.15)
    assert all(text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["text"] for c in parts) and len(parts) > 3
    words = chunking.chunk_text("word " * 400, "a.txt", 20, 0.2)
    assert all(b["byte_start"] < a["byte_end"] for a, b in zip(words, words[1:], strict=False))
    marked = chunking.chunk_text("# One\n" + "x " * 200 + "\n# Two\n" + "y " * 200, "a.md", 130, 0.0)
    assert [c["text"].split("\n")[0] for c in marked] == ["# One", "# Two"] and marked[1]["line_start"] == 3
    code = chunking.chunk_text("import a\n" * 20 + "def f():\n" + "    pass\n" * 30 + "class B:\n" + "    x = 1\n" * 30, "a.py", 200, 0.0)
    assert [c["text"][:5] for c in code] == ["impor", "def f", "class"]
    assert chunking.chunk_text(" \n ", "a.txt") == []
    long = "A sentence here. Another one! " * 100
    assert "".join(chunking.sentence_windows(long)) == long and len(chunking.sentence_windows(long)) > 1


def test_providers():
    assert providers.make("reranker", {"provider": "none"}) is None
    with pytest.raises(ProviderError):
        providers.make("embedder", {"provider": "what"})
    assert providers.make("reranker", {"provider": "bad"}, {"bad": lambda s: 1 / 0}) is None
    with pytest.raises(ProviderError):
        providers.make("embedder", {"provider": "bad"}, {"bad": lambda s: 1 / 0})


def test_config(tmp_path):
    from heatgraph.plans import config as cfg

    (tmp_path / cfg.FILE).write_text(cfg.dump(cfg.Config().set("graph.k", "5").set("corpus.include", "*.md, *.txt")))
    config, notes = cfg.load(tmp_path / cfg.FILE)
    assert config.graph.k == 5 and config.corpus.include == ("*.md", "*.txt") and not notes
    (tmp_path / "rc.toml").write_text("[graph]\nk = 6\n")
    config, notes = cfg.load(tmp_path / cfg.FILE, tmp_path / "rc.toml")
    assert config.graph.k == 6 and len(notes) == 1
    for bad in (("graph.what", 1), ("graph.k", "x"), ("corpus.respect_gitignore", "maybe")):
        with pytest.raises(ConfigError):
            cfg.Config().set(*bad)
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert cfg.find_root(tmp_path / "a" / "b") == tmp_path.resolve()
