"""Queries over the driver's tables, one for each family of operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgraph.functions import chunking, vectors
from heatgraph.operators import communities, edges, evaluation, expansion, knn, lookups, maintenance, ranking, traversal
from heatgraph.operators.components import connected_components
from heatgraph.plans.config import Config
from heatgraph.plans.query import Options, run_query
from heatgraph.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K, FLOOR = 8, 0.3  # the test vectors' best cosines lie between 0.27 and 0.51


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _probe(spark: SparkSession, d: str) -> list[float]:
    return _emb(spark, d).filter("id = 7").first()["vector"]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The graph of a full build over the test vectors."""
    v = _emb(spark, d)
    lists = edges.knn_edges(v, None, K, FLOOR).select("src", "dst", "weight")
    return edges.replace_edges(lists.limit(0), lists, v.select("id", F.col("id").alias("ord")))


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two variants of each query: its own vector and the next one's."""
    own = _asked(spark, d)
    near = _emb(spark, d).filter("id % 50 = 1").select((F.col("id") - 1).alias("query_id"), "vector")
    both = own.select((F.col("query_id") * 2).alias("query_id"), "vector").unionByName(near.select((F.col("query_id") * 2 + 1).alias("query_id"), "vector"))
    found = knn.search_batch(_emb(spark, d), both, 20)
    return found.select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).alias("variant"), "id", "sim", "rank")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    first = _rankings(spark, d).filter("variant = 0")
    return ranking.rrf(first).withColumnRenamed("fused", "heat")


def _sims(spark: SparkSession, d: str) -> DataFrame:
    found = knn.search_batch(_emb(spark, d), _asked(spark, d), 2**31 - 1)
    return found.select("query_id", "id", "sim")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks."""
    return _docs(spark, d).select("id", F.concat("source", F.lit("/"), F.col("id").cast("string"), F.lit(".txt")).alias("file_path"), "text", F.lit(0).alias("byte_start"), F.octet_length("text").alias("byte_end"), F.lit(1).alias("line_start"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("line_end"))


_EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_SIM = "round(least(1.0, greatest(0.0, list_inner_product(a.v, b.v))), 9)"
_PAIRS = f"pairs AS (SELECT a.id AS src, b.id AS dst, {_SIM} AS w FROM emb a JOIN emb b ON a.id <> b.id)"
_KNN = f"knn AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM pairs WHERE w >= {FLOOR}) WHERE rn <= {K})"
_STORED = "edges AS (SELECT dst AS src, src AS dst, w AS weight FROM knn WHERE src > dst)"
_BOTH = "sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
_GRAPH = (_EMB, _PAIRS, _KNN, _STORED, _BOTH)
_SIMS = f"sims AS (SELECT a.id AS query_id, b.id, {_SIM} AS sim FROM emb a, emb b WHERE a.id % 50 = 0)"
_RANK = f"rankings AS (SELECT * FROM (SELECT a.id - a.id % 50 AS query_id, a.id % 50 AS variant, b.id, {_SIM} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {_SIM} DESC, b.id) AS rank FROM emb a, emb b WHERE a.id % 50 < 2) WHERE rank <= 20)"
_FUSED = "fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM rankings GROUP BY query_id, id)"
_SEEDS = "seeds AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS heat FROM rankings WHERE variant = 0)"


def _hop(n: int, before: str, front: str) -> str:
    return f"""best{n} AS (SELECT query_id, id, c FROM (
  SELECT f.query_id, s.dst AS id, f.heat * s.weight * 0.5 AS c, row_number() OVER (PARTITION BY f.query_id, s.dst ORDER BY f.heat * s.weight * 0.5 DESC) AS rn
  FROM {front} f JOIN sym s ON s.src = f.id LEFT JOIN seeds e ON e.query_id = f.query_id AND e.id = s.dst
  LEFT JOIN sims m ON m.query_id = f.query_id AND m.id = s.dst WHERE e.id IS NOT NULL OR coalesce(m.sim, 0) >= 0.1) WHERE rn = 1),
heat{n} AS (SELECT query_id, id, CASE WHEN h.heat IS NULL OR b.c > h.heat THEN b.c ELSE h.heat END AS heat,
  CASE WHEN b.c IS NOT NULL AND (h.heat IS NULL OR b.c > h.heat) THEN {n} ELSE h.hop END AS hop,
  (b.c IS NOT NULL AND (h.heat IS NULL OR b.c > h.heat)) AS up FROM {before} h FULL JOIN best{n} b USING (query_id, id)),
front{n} AS (SELECT query_id, id, heat FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY heat DESC, id) AS rn FROM heat{n} WHERE up) WHERE rn <= 150)"""


def _embedded(name: str, table: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {table}),
{name}_b AS (SELECT id, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*)::DOUBLE AS n FROM {name}_w WHERE w <> '' GROUP BY ALL),
{name}_m AS (SELECT id, map_from_entries(list((bucket, n))) AS m, sqrt(sum(n * n)) AS norm FROM {name}_b GROUP BY id),
{name} AS (SELECT id, list_transform(range(64), lambda b: coalesce(m[b::INT], 0.0) / norm) AS v FROM {name}_m)"""


# vectors and search


@query(_with(_EMB) + f"SELECT b.id, {_SIM} AS sim FROM emb a, emb b WHERE a.id = 7 ORDER BY sim DESC, b.id LIMIT 10")
def vector_topk(spark, d):
    return knn.search(_emb(spark, d), _probe(spark, d), 10)


@query(_with(_EMB) + f"SELECT * FROM (SELECT a.id AS query_id, b.id, {_SIM} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {_SIM} DESC, b.id)::INT AS rank FROM emb a, emb b WHERE a.id % 50 = 0) WHERE rank <= 20")
def vector_topk_batch(spark, d):
    return knn.search_batch(_emb(spark, d), _asked(spark, d), 20)


@query(_with(_EMB) + "SELECT b.id, round(greatest(0.0, list_inner_product(a.v, b.v)), 9) AS sim FROM emb a, emb b WHERE a.id = 7 AND list_inner_product(a.v, b.v) >= 0.1")
def cosine_floor_filter(spark, d):
    return knn.floor_filter(_emb(spark, d), _probe(spark, d), 0.1)


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3)) / sqrt(list_inner_product(list_transform(embedding::DOUBLE[], lambda x: x * 3), list_transform(embedding::DOUBLE[], lambda x: x * 3))), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    big = _emb(spark, d).select("id", F.transform("vector", lambda x: x.cast("double") * 3).alias("v"))
    return big.select("id", F.round(F.aggregate(vectors.l2_normalize("v"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT e.vec_id AS id, i.ord, round(e.embedding[1]::DOUBLE, 6) AS first FROM embeddings e JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC)::INT AS ord FROM embeddings WHERE vec_id % 100 = 3) i USING (vec_id)")
def get_vectors(spark, d):
    """Every hundredth id or so, asked for in descending order."""
    ids = _emb(spark, d).filter("id % 100 = 3").select("id", (-F.col("id")).alias("back"))
    wanted = maintenance.assign_ids(ids, 0, ("back",), "ord").select("id", F.col("ord").cast("int").alias("ord"))
    return knn.get_vectors(_emb(spark, d), wanted).select("id", "ord", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0")
def vector_delete(spark, d):
    gone = _emb(spark, d).filter("id % 7 = 0").select("id")
    return _emb(spark, d).join(gone.unionByName(gone), "id", "left_anti").select("id")


@query(_with(_embedded("e", "documents", "doc_id")) + "SELECT id, (b - 1)::INT AS bucket, round(v[b], 6) AS x FROM e, range(1, 65) r(b) WHERE v[b] > 0")
def hash_embed(spark, d):
    v = vectors.hash_embed(_docs(spark, d))
    return v.select("id", F.posexplode("vector").alias("bucket", "x")).filter("x > 0").withColumn("x", F.round("x", 6))


# the graph


@query(_with(_EMB, _PAIRS, _KNN) + "SELECT src, dst, w AS weight FROM knn")
def knn_edges(spark, d):
    return edges.knn_edges(_emb(spark, d), None, K, FLOOR).select("src", "dst", "weight")


@query(_with(*_GRAPH) + "SELECT src, dst, weight FROM edges")
def knn_edges_stored(spark, d):
    return _stored(spark, d)


_SUBS = f"""subs AS (SELECT id // 4 AS chunk, id % 4 AS ord, v, id FROM emb),
chunk AS (SELECT chunk, list_transform(range(1, 65), lambda i: t[i]) AS s FROM (SELECT chunk, list(v) AS vs, [{", ".join(f"sum(v[{i}])" for i in range(1, 65))}] AS t FROM subs GROUP BY chunk)),
unit AS (SELECT chunk AS id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS v FROM chunk),
near AS (SELECT * FROM (SELECT a.chunk AS src, b.chunk AS dst, {_SIM} AS w, row_number() OVER (PARTITION BY a.id ORDER BY {_SIM} DESC, b.chunk, b.ord) AS rn FROM subs a JOIN subs b ON a.chunk <> b.chunk WHERE {_SIM} >= {FLOOR}) WHERE rn <= {K}),
found AS (SELECT src, dst, max(w) AS weight FROM near GROUP BY src, dst)"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every four vectors as the parts of a chunk, and their sums, normalised, as whole chunks."""
    subs = _emb(spark, d).select(F.expr("id div 4").alias("chunk_id"), (F.col("id") % 4).cast("int").alias("ord"), "vector")
    total = F.array(*(F.sum(F.get("vector", F.lit(i)).cast("double")) for i in range(64)))
    return subs, subs.groupBy(F.col("chunk_id").alias("id")).agg(total.alias("v")).select("id", vectors.l2_normalize("v").alias("vector"))


@query(_with(_EMB, _SUBS) + "SELECT src, dst, weight FROM found f JOIN unit a ON a.id = src JOIN unit b ON b.id = dst WHERE list_inner_product(a.v, b.v) < 0.9")
def subchunk_knn_edges(spark, d):
    subs, whole = _parts(spark, d)
    return edges.subchunk_edges(subs, whole, None, K, FLOOR)


@query(_with(_EMB, _SUBS) + "SELECT src, dst, weight FROM found f JOIN unit a ON a.id = src JOIN unit b ON b.id = dst WHERE list_inner_product(a.v, b.v) < 0.15")
def near_dup_guard(spark, d):
    subs, whole = _parts(spark, d)
    return edges.subchunk_edges(subs, whole, None, K, FLOOR, near_dup=0.15)


@query(_with(_EMB, _PAIRS, _KNN) + "SELECT DISTINCT dst AS id FROM knn WHERE src % 3 = 0 AND dst NOT IN (SELECT src FROM knn WHERE src % 3 = 0)")
def affected_ids(spark, d):
    v = _emb(spark, d)
    return edges.affected_ids(edges.knn_edges(v, v.filter("id % 3 = 0"), K, FLOOR))


@query(_with(*_GRAPH) + """SELECT src, dst, weight FROM edges WHERE src % 5 <> 0 AND dst % 5 <> 0
UNION ALL SELECT least(src, dst), greatest(src, dst), w FROM knn WHERE src % 5 = 0 AND w >= 0.32 AND (dst % 5 <> 0 OR src < dst)""")
def replace_edges(spark, d):
    """Every fifth node gets a new list, in descending order of id."""
    v = _emb(spark, d)
    some = v.filter("id % 5 = 0").select("id")
    lists = edges.knn_edges(v, some, K, FLOOR).filter("weight >= 0.32").select("src", "dst", "weight")
    return edges.replace_edges(_stored(spark, d), lists, some.select("id", (-F.col("id")).alias("ord")))


@query(_with(*_GRAPH) + "SELECT src AS id, dst AS neighbor, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INT AS rank FROM sym WHERE src % 10 = 0")
def neighbors(spark, d):
    return edges.neighbors(_stored(spark, d), _emb(spark, d).filter("id % 10 = 0").select("id"))


@query(_with(*_GRAPH) + "SELECT src AS id, count(*) AS degree, max(weight) AS heaviest FROM sym GROUP BY src")
def degree_distribution(spark, d):
    return edges.degrees(_stored(spark, d))


@query(_with(*_GRAPH) + "SELECT src, dst, weight FROM edges WHERE src % 4 <> 0 AND dst % 4 <> 0")
def delete_incident(spark, d):
    return edges.delete_incident(_stored(spark, d), _emb(spark, d).filter("id % 4 = 0").select("id"))


@query(_with(*_GRAPH, "reach AS (SELECT src AS node, src AS other FROM sym UNION SELECT r.node, s.dst FROM reach r JOIN sym s ON s.src = r.other)") + "SELECT node, min(other) AS component FROM reach GROUP BY node")
def connected_components_of_graph(spark, d):
    return connected_components(_stored(spark, d))


@query()
def graph_communities(spark, d):
    return communities.communities(_stored(spark, d))


_LABELLED = "members AS (SELECT vec_id AS chunk_id, label AS community_id FROM embeddings)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("community_id"))


@query(_with(_LABELLED) + "SELECT community_id, count(*) AS size FROM members GROUP BY community_id")
def community_sizes(spark, d):
    return communities.community_sizes(_members(spark, d))


@query(_with(_LABELLED, "few AS (SELECT community_id, source, min(chunk_id) AS least, row_number() OVER (PARTITION BY community_id ORDER BY min(chunk_id)) AS r FROM members JOIN documents ON doc_id = chunk_id GROUP BY community_id, source)") + "SELECT community_id, size, files FROM (SELECT community_id, count(*) AS size FROM members GROUP BY community_id) LEFT JOIN (SELECT community_id, array_to_string(list(source ORDER BY least), ',') AS files FROM few WHERE r <= 3 GROUP BY community_id) USING (community_id)")
def community_preview(spark, d):
    rows = _docs(spark, d).select("id", F.col("source").alias("file_path"))
    return communities.community_preview(_members(spark, d), rows).withColumn("files", F.array_join("files", ","))


@query(_with(_LABELLED) + "SELECT chunk_id, community_id, source || '/' || doc_id || '.txt' AS file_path, 1 AS line_start FROM members JOIN documents ON doc_id = chunk_id WHERE community_id = 2")
def community_members(spark, d):
    return lookups.community_members(_members(spark, d), _chunks(spark, d), 2).drop("line_end")


# queries


@query(_with(_EMB, _RANK) + "SELECT query_id, variant, id, sim, rank::INT AS rank FROM rankings")
def fanout_search(spark, d):
    return _rankings(spark, d)


@query(_with(_EMB, _RANK, _FUSED) + "SELECT query_id, id, round(fused, 9) AS fused FROM fused")
def rrf_fusion(spark, d):
    return ranking.rrf(_rankings(spark, d)).withColumn("fused", F.round("fused", 9))


def _heat(spark: SparkSession, d: str, hops: int) -> DataFrame:
    return traversal.heat_by_hop(_seeds(spark, d), _stored(spark, d), _sims(spark, d), hops, floor=0.1)


@query(_with(*_GRAPH, _SIMS, _RANK, _SEEDS, "heat0 AS (SELECT *, 0 AS hop FROM seeds)", _hop(1, "heat0", "heat0")) + "SELECT query_id, id, round(heat, 9) AS heat, hop FROM heat1")
def heat_hop1(spark, d):
    return _heat(spark, d, 1).select("query_id", "id", F.round("heat", 9).alias("heat"), "hop")


@query(_with(*_GRAPH, _SIMS, _RANK, _SEEDS, "heat0 AS (SELECT *, 0 AS hop FROM seeds)", _hop(1, "heat0", "heat0"), _hop(2, "heat1", "front1")) + "SELECT query_id, id, round(heat, 9) AS heat, hop FROM heat2")
def heat_hop2(spark, d):
    return _heat(spark, d, 2).select("query_id", "id", F.round("heat", 9).alias("heat"), "hop")


@query()
def heat_in_order(spark, d):
    return traversal.heat_in_order(_seeds(spark, d), _stored(spark, d), _sims(spark, d), 2, floor=0.1)


@query(_with(*_GRAPH, _SIMS, _RANK, _SEEDS, "heat0 AS (SELECT *, 0 AS hop FROM seeds)", _hop(1, "heat0", "heat0")) + """SELECT query_id, id, seed, parent, weight AS edge_weight FROM (
SELECT h.query_id, h.id, f.id AS seed, f.id AS parent, s.weight, row_number() OVER (PARTITION BY h.query_id, h.id ORDER BY f.heat * s.weight * 0.5 DESC, f.id) AS rn
FROM heat1 h JOIN sym s ON s.dst = h.id JOIN seeds f ON f.query_id = h.query_id AND f.id = s.src WHERE h.hop = 1) WHERE rn = 1""")
def heat_trace(spark, d):
    return _heat(spark, d, 1).filter("hop = 1").select("query_id", "id", "seed", "parent", "edge_weight")


@query(_with(*_GRAPH, _SIMS, _RANK, _SEEDS, "heat0 AS (SELECT *, 0 AS hop FROM seeds)", _hop(1, "heat0", "heat0")) + "SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY heat DESC, id)::INT AS rank FROM heat1 WHERE hop = 1) WHERE rank <= 5")
def frontier_topk(spark, d):
    warm = _heat(spark, d, 1).filter("hop = 1")
    return knn.rank_within(warm, ["query_id"], 5, [F.desc("heat"), F.asc("id")]).select("query_id", "id", "rank")


def _mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


_SIGNALS = "signals AS (SELECT query_id, id, round(fused, 12) AS vector, CASE WHEN id % 3 <> 0 THEN (id % 11)::DOUBLE END AS heat, (id % 7)::DOUBLE AS rerank FROM fused)"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Fused scores with two made-up signals, one of them with gaps."""
    fused = ranking.rrf(_rankings(spark, d))
    return fused.select("query_id", "id", F.round("fused", 12).alias("vector"), F.when(F.col("id") % 3 != 0, (F.col("id") % 11).cast("double")).alias("heat"), (F.col("id") % 7).cast("double").alias("rerank"))


_FILLED = "filled AS (SELECT query_id, id, vector, coalesce(heat, 0.0) AS heat, rerank FROM signals)"
_SCALED = f"scaled AS (SELECT *, {_mm('vector')} AS v1, {_mm('heat')} AS h1, {_mm('rerank')} AS r1 FROM filled WINDOW w AS (PARTITION BY query_id))"
_BASE = (_EMB, _RANK, _FUSED, _SIGNALS, _FILLED, _SCALED)


@query(_with(*_BASE) + "SELECT query_id, id, round(v1, 6) AS scaled FROM scaled")
def minmax_normalize(spark, d):
    return _signals(spark, d).select("query_id", "id", F.round(ranking.min_max("vector", ["query_id"]), 6).alias("scaled"))


@query(_with(*_BASE) + "SELECT query_id, id, round((0.25 * h1 + 0.15 * v1) / 0.4, 6) AS score FROM scaled")
def combine_no_rerank(spark, d):
    return ranking.combine(_signals(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_with(*_BASE) + "SELECT query_id, id, round(0.6 * r1 + 0.25 * h1 + 0.15 * v1, 6) AS score FROM scaled")
def combine_rerank(spark, d):
    return ranking.combine(_signals(spark, d), rerank=True).select("query_id", "id", F.round("score", 6).alias("score"))


_SCORED = "scored AS (SELECT query_id, id, round(0.6 * r1 + 0.25 * h1 + 0.15 * v1, 9) AS score FROM scaled)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return ranking.combine(_signals(spark, d), rerank=True).withColumn("score", F.round("score", 9)).select("query_id", "id", "score")


@query(_with(*_BASE, _SCORED) + "SELECT query_id, id, score, length(text)::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM scored) JOIN documents ON doc_id = id WHERE rn <= 12 AND doc_id % 9 <> 0")
def rerank_shortlist(spark, d):
    chunks = _docs(spark, d).filter("id % 9 <> 0")
    return ranking.shortlist(_scored(spark, d), chunks, 12).select("query_id", "id", "score", F.length("text").alias("size"))


_TOP = "top8 AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= 8)"


@query(_with(*_BASE, _SCORED, _TOP) + "SELECT query_id, id, score, rank FROM top8")
def final_topn(spark, d):
    return ranking.top_n(_scored(spark, d), 8)


@query(_with(*_BASE, _SCORED, _TOP, "f AS (SELECT t.*, source AS file, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, rank) AS r FROM top8 t JOIN documents ON doc_id = id)", "g AS (SELECT query_id, file, round(sum(CASE WHEN r <= 3 THEN score END), 6) AS score, array_to_string(list(id ORDER BY r), ',') AS chunk_ids, min(rank) AS first FROM f GROUP BY query_id, file)") + "SELECT query_id, file, score, chunk_ids, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS position FROM g")
def files_top3(spark, d):
    rows = ranking.top_n(_scored(spark, d), 8).join(_docs(spark, d).select("id", F.col("source").alias("file")), "id")
    return ranking.file_scores(rows).withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query(_with(*_BASE, _SCORED, _TOP) + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, id AS chunk_id, source || '/' || doc_id || '.txt' AS file, round(score, 6) AS score, substr(text, 1, 1200) AS text, length(text) > 1200 AS truncated FROM top8 JOIN documents ON doc_id = id")
def query_json(spark, d):
    """The JSON documents, read again."""
    rows = ranking.top_n(_scored(spark, d), 8).join(_chunks(spark, d).withColumnRenamed("file_path", "file"), "id")
    rows = rows.withColumns({"query": F.col("query_id").cast("string"), "vector": F.lit(0.0), "heat": F.lit(0.0), "rerank": F.lit(0.0), "explain": F.lit(None).cast("string")})
    shape = "struct<results:array<struct<chunk_id:long,file:string,score:double,text:string,truncated:boolean>>>"
    docs = ranking.result_json(rows).select("query_id", F.posexplode(F.from_json("json", shape)["results"]).alias("at", "r"))
    return docs.select("query_id", (F.col("at") + 1).alias("rank"), "r.*")


# chunking

_END = """CASE WHEN n - {a} <= 4800 THEN n ELSE {a} + (SELECT CASE {cases} ELSE 4800 END FROM (SELECT substr(text, {a} + 1, 4800) AS region)) END"""


def _end(a: str) -> str:
    cases = " ".join(f"WHEN contains(region, {s}) THEN 4800 - (position(reverse({s}) IN reverse(region)) - 1)" for s in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"))
    return _END.format(a=a, cases=cases)


_NEXT = "CASE WHEN b - round_even((b - a) * 0.15, 0) <= a THEN b ELSE b - round_even((b - a) * 0.15, 0)::BIGINT END"


def _split_sql(start: str, most: int, least: int, overlap: float = 0.15) -> str:
    """Windows of ``start(doc_id, text, path, base, stop)`` from base to stop, joined while small, with their positions."""
    ends = lambda a: f"CASE WHEN stop - {a} <= {most} THEN stop ELSE {a} + (SELECT CASE {{cases}} ELSE {most} END FROM (SELECT substr(text, {a} + 1, {most}) AS region)) END".replace(
        "{cases}", " ".join(f"WHEN contains(region, {s}) THEN {most} - (position(reverse({s}) IN reverse(region)) - 1)" for s in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")))
    step = f"CASE WHEN b - round_even((b - a) * {overlap}, 0) <= a THEN b ELSE b - round_even((b - a) * {overlap}, 0)::BIGINT END"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE start AS ({start}),
w AS (SELECT doc_id, path, text, stop, base AS a, {ends("base")} AS b FROM start
UNION ALL SELECT doc_id, path, text, stop, s AS a, {ends("s")} AS b FROM (SELECT doc_id, path, text, stop, {step} AS s FROM w WHERE b < stop)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS i, length(trim(substr(text, a + 1, b - a), {blank})) < {least} AS small FROM w),
g AS (SELECT *, sum(CASE WHEN i = 1 OR NOT small THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
m AS (SELECT doc_id, path, text, g, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
h AS (SELECT *, CASE WHEN g = 2 AND first_small THEN 1 ELSE g END AS g2 FROM (SELECT *, bool_or(g = 1 AND length(trim(substr(text, a + 1, b - a), {blank})) < {least}) OVER (PARTITION BY doc_id) AS first_small FROM m)),
c AS (SELECT doc_id, path, text, min(a) AS a, max(b) AS b FROM h GROUP BY doc_id, path, text, g2)
SELECT path AS file_path, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INT AS pos, substr(text, a + 1, b - a) AS text, strlen(substr(text, 1, a))::INT AS byte_start, strlen(substr(text, 1, b))::INT AS byte_end,
(1 + a - length(replace(substr(text, 1, a), chr(10), '')))::INT AS line_start, (1 + b - 1 - length(replace(substr(text, 1, b - 1), chr(10), '')))::INT AS line_end
FROM c WHERE length(trim(substr(text, a + 1, b - a), {blank})) > 0"""


_WHOLE = "SELECT doc_id, text, source || '/' || doc_id || '.txt' AS path, 0::BIGINT AS base, length(text) AS stop FROM documents WHERE length(text) > 0"
_CODE = """SELECT doc_id, text, path, base, lead(base, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY base) AS stop FROM (
SELECT DISTINCT doc_id, text, path, unnest([0::BIGINT] || list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 9 + 1)::BIGINT)) AS base
FROM (SELECT doc_id, text, path, string_split(text, chr(10) || 'def f():') AS parts FROM (SELECT doc_id, source || '/' || doc_id || '.py' AS path, 'import x' || chr(10) || regexp_replace(text, '\\.\\n', '.' || chr(10) || 'def f():' || chr(10), 'g') AS text FROM documents)))"""
_MARKDOWN = """WITH RECURSIVE f AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, '# Top' || chr(10) || regexp_replace(text, '\\.\\n', '.' || chr(10) || '## Part' || chr(10), 'g') AS text FROM documents),
l AS (SELECT *, list_transform(string_split_regex(text, '\\n#{1,6} '), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, '\\n#{1,6} '), lambda x: length(x)) AS lens FROM f),
s AS (SELECT doc_id, path, text, [0::BIGINT] || list_transform(range(1, len(lens) + 1), lambda i: (list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) + 1)::BIGINT) || [length(text)] AS e FROM l),
r AS (SELECT doc_id, path, text, e, 1::BIGINT AS i, e[1] AS a, e[2] AS b, e[1] AS pa, e[2] - e[1] <= 2400 AS growing, 1 AS part FROM s
UNION ALL SELECT doc_id, path, text, e, i + 1, a, b, CASE WHEN same THEN pa ELSE a END, b - a <= 2400, CASE WHEN same THEN part ELSE part + 1 END
FROM (SELECT *, growing AND b - a <= 2400 AND b - pa <= 1600 AS same FROM (SELECT doc_id, path, text, e, i, e[i + 1] AS a, e[i + 2] AS b, pa, growing, part FROM r WHERE i + 1 < len(e))))
SELECT doc_id, text, path, min(a) AS base, max(b) AS stop FROM r GROUP BY doc_id, text, path, part"""
_SENTENCES = """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n, list_transform(regexp_extract_all(text, '[.!?]\\s+|\\n+'), lambda x: length(x)) AS lens,
list_transform(string_split_regex(text, '[.!?]\\s+|\\n+'), lambda x: length(x)) AS gaps FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, n, list_transform(range(1, len(lens) + 1), lambda i: (list_sum(gaps[1:i]) + list_sum(lens[1:i]))::BIGINT) || [n] AS ends FROM d),
w AS (SELECT doc_id, text, n, ends, 0::BIGINT AS a, CASE WHEN n <= 768 THEN n ELSE {first} END AS b FROM s
UNION ALL SELECT doc_id, text, n, ends, b AS a, {next} AS b FROM w WHERE b < n),
p AS (SELECT doc_id, text, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i, length(trim(substr(text, a + 1, b - a), {blank})) < 128 AS small FROM w),
g AS (SELECT *, sum(CASE WHEN i = 1 OR NOT small THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
m AS (SELECT doc_id, text, g, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
h AS (SELECT *, CASE WHEN g = 2 AND bool_or(g = 1 AND length(trim(substr(text, a + 1, b - a), {blank})) < 128) OVER (PARTITION BY doc_id) THEN 1 ELSE g END AS g2 FROM m),
c AS (SELECT doc_id, text, min(a) AS a, max(b) AS b FROM h GROUP BY doc_id, text, g2)
SELECT doc_id AS chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS ord, substr(text, a + 1, b - a) AS text FROM c"""


def _sentence_sql() -> str:
    """Windows that end at the last sentence end within 512 characters, else at the first one beyond; small ones joined."""
    end = lambda a: f"CASE WHEN {a} + 512 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e > {a} AND e <= {a} + 512)), list_min(list_filter(ends, lambda e: e > {a} + 512))) END"
    return _SENTENCES.format(first=end("0"), next=end("b"), blank="' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS a, {_end("0")} AS b FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0)
UNION ALL SELECT doc_id, text, n, s AS a, {_end("s")} AS b FROM (SELECT doc_id, text, n, {_NEXT} AS s FROM w WHERE b < n))
SELECT doc_id, a::INT AS char_start, b::INT AS char_end, strlen(substr(text, 1, a))::INT AS byte_start, strlen(substr(text, 1, b))::INT AS byte_end,
(1 + a - length(replace(substr(text, 1, a), chr(10), '')))::INT AS line_start, (1 + b - 1 - length(replace(substr(text, 1, b - 1), chr(10), '')))::INT AS line_end FROM w""")
def chunk_windows(spark, d):
    """The windows of the plain splitter, with byte and line positions by column functions."""
    size = 800

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def spans(texts):
        import pandas as pd

        return pd.Series([[{"a": a, "b": b} for a, b in chunking.window_spans(t or "", size, 0.15)] for t in texts])

    rows = _docs(spark, d).select(F.col("id").alias("doc_id"), "text", F.explode(spans("text")).alias("s"))
    head = lambda n: F.substring("text", F.lit(1), n)
    line = lambda n: 1 + n - F.length(F.replace(head(n), F.lit("\n"), F.lit("")))
    a, b = F.col("s.a"), F.col("s.b")
    return rows.select("doc_id", a.alias("char_start"), b.alias("char_end"), F.octet_length(head(a)).alias("byte_start"), F.octet_length(head(b)).alias("byte_end"), line(a).alias("line_start"), line(b - 1).alias("line_end"))


@query(_split_sql(_WHOLE, 4800, 100))
def chunk_documents(spark, d):
    return chunking.chunk_files(corpus.from_table(_t(spark, d, "documents")))


@query(_sentence_sql())
def subchunk_windows(spark, d):
    """Sentence windows of documents."""
    return chunking.split_sentences(_docs(spark, d).filter("length(text) > 0"))


def _as_files(spark: SparkSession, d: str, kind: str, head: str, mark: str) -> DataFrame:
    """Documents as files of a kind: each line break that a sentence end stands before begins a section."""
    docs = _t(spark, d, "documents")
    text = F.concat(F.lit(head), F.regexp_replace("text", r"\.\n", f".\n{mark}"))
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(kind)).alias("path"), text.alias("text"))


@query(_split_sql(_MARKDOWN, 2400, 100))
def chunk_markdown(spark, d):
    return chunking.chunk_files(_as_files(spark, d, ".md", "# Top\n", "## Part\n"), 400)


@query(_split_sql(_CODE, 2400, 100))
def chunk_code(spark, d):
    return chunking.chunk_files(_as_files(spark, d, ".py", "import x\n", "def f():\n"), 400)


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 OR regexp_matches(coalesce(text, ''), '^\\s*$') THEN 0 ELSE 1 END AS chunks FROM documents")
def chunk_blank_files(spark, d):
    """How many chunks short files have: half of them are made blank, and blank files have none."""
    short = F.when(F.col("id") % 4 == 0, F.lit("")).when(F.col("id") % 4 == 1, F.lit(" \n\t ")).otherwise(F.substring("text", 1, 400))
    files = _docs(spark, d).select(F.col("id").cast("string").alias("path"), short.alias("text"))
    found = chunking.chunk_files(files).groupBy("file_path").agg(F.count("*").cast("int").alias("chunks"))
    return files.join(found, files["path"] == found["file_path"], "left").select(F.col("path").cast("long").alias("doc_id"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT source || '/' || doc_id || '.txt' AS path FROM documents WHERE source <> 'src3' AND regexp_matches(source, '^src1') AND (doc_id % 10 <> 7 OR doc_id = 17)")
def corpus_filters(spark, d):
    """Include, exclude and ignore patterns over paths; the last ignore pattern that matches decides."""
    files = _chunks(spark, d).select(F.col("file_path").alias("path"), F.lit(10).cast("long").alias("length"))
    return corpus.selected(files, ["src1*/**"], ["src3/"], ["# comment", "*7.txt", "!17.txt"]).select("path")


@query("SELECT doc_id AS id, replace(text, chr(10), ' / ') AS text, doc_id % 2 = 0 AND strlen(replace(text, chr(10), chr(13) || chr(10))) < 8192 AS binary FROM documents")
def decoded_texts(spark, d):
    """Bytes with Windows line ends, every other one with a zero byte at its end (seen only near the beginning), decoded."""
    raw = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary"), F.when(F.col("id") % 2 == 0, F.lit(b"\0")).otherwise(F.lit(b"")))
    rows = _docs(spark, d).select("id", F.length("text").alias("n"), raw.alias("content"))
    clean = F.replace(corpus.decode_text("content"), F.lit("\0"), F.lit(""))
    return rows.select("id", F.replace(clean, F.lit("\n"), F.lit(" / ")).alias("text"), corpus.is_binary("content").alias("binary"))


# maintenance


_KNOWN = "known AS (SELECT source || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0)"
_CURRENT = "cur AS (SELECT source || '/' || doc_id || '.txt' AS path, sha256(CASE WHEN doc_id % 5 = 1 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 7 <> 0)"
_CHANGE = "ch AS (SELECT path, CASE WHEN k.content_hash IS NULL THEN 'new' WHEN c.content_hash IS NULL THEN 'deleted' WHEN k.content_hash <> c.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM known k FULL JOIN cur c USING (path))"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents")
    edited = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tuple(corpus.from_table(x).select("path", "content_hash") for x in (docs.filter("doc_id % 10 <> 0"), edited))


@query(_with(_KNOWN, _CURRENT, _CHANGE) + "SELECT path, change FROM ch")
def hash_diff(spark, d):
    return maintenance.diff(*_versions(spark, d))


@query(_with(_KNOWN, _CURRENT, _CHANGE) + "SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted FROM ch")
def drift(spark, d):
    return maintenance.drift(*_versions(spark, d))


@query(_with(_KNOWN, _CURRENT) + "SELECT path, content_hash FROM cur UNION ALL SELECT path, content_hash FROM known WHERE path NOT IN (SELECT path FROM cur)")
def upsert_files(spark, d):
    known, current = _versions(spark, d)
    return maintenance.upsert(known, current, "path")


def _cascade(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    chunks = _chunks(spark, d)
    files = chunks.select(F.col("file_path").alias("path"))
    return maintenance.cascade_delete({"files": files, "chunks": chunks, "edges": _stored(spark, d), "communities": _members(spark, d)}, files.filter(F.col("path").startswith("src1/")))


@query(_with(*_GRAPH, "gone AS (SELECT doc_id FROM documents WHERE source = 'src1')") + """SELECT 'files' AS part, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'chunks', count(*) FROM documents WHERE source <> 'src1'
UNION ALL SELECT 'removed', count(*) FROM gone UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN (SELECT doc_id FROM gone) AND dst NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'communities', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)""")
def cascade_delete(spark, d):
    out = [t.agg(F.lit(name).alias("part"), F.count("*").alias("n")).select("part", "n") for name, t in _cascade(spark, d).items()]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


@query("SELECT doc_id, 1000 + row_number() OVER (ORDER BY source, doc_id) AS id FROM documents")
def id_assignment(spark, d):
    return maintenance.assign_ids(_t(spark, d, "documents").select("source", "doc_id"), 1000, ("source", "doc_id")).select("doc_id", "id")


@query("SELECT * FROM (VALUES ('chunk_overlap', true), ('chunk_size_tokens', false), ('edge_source', true), ('embedding_model', true), ('subchunk_size_tokens', true)) t(key, ok)")
def manifest_check(spark, d):
    """Which settings of an index may differ: one at a time is changed, and the guard asked."""
    from heatgraph.errors import ManifestError

    old = {k: str(v) for k, v in Config().manifest().items()}
    rows = []
    for k in sorted(old):
        wanted = {**old, "chunk_size_tokens": "400"} if k == "chunk_size_tokens" else old | ({"subchunk_size_tokens": "64"} if k == "subchunk_size_tokens" else {})
        try:
            maintenance.check_manifest(old, wanted)
            rows.append((k, True))
        except ManifestError:
            rows.append((k, False))
    return spark.createDataFrame(rows, "key string, ok boolean")


# lookups and reports


@query("SELECT doc_id AS id, (1000000 - doc_id)::BIGINT AS ord, length(text)::INT AS size FROM documents WHERE doc_id % 13 = 0")
def get_chunks_ordered(spark, d):
    chunks = _chunks(spark, d)
    wanted = chunks.filter("id % 13 = 0").select("id").distinct().select("id", (1_000_000 - F.col("id")).alias("ord"))
    return lookups.get_chunks(chunks, wanted).select("id", "ord", F.length("text").alias("size"))


@query("SELECT source || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash FROM documents")
def file_hashes(spark, d):
    return lookups.file_hashes(corpus.from_table(_t(spark, d, "documents")))


@query("SELECT doc_id AS id FROM documents WHERE source = 'src2' AND doc_id = 2")
def chunk_ids_for_file(spark, d):
    return lookups.chunk_ids_for_file(_chunks(spark, d), "src2/2.txt")


@query(_with(*_GRAPH) + "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT label) FROM embeddings) AS communities")
def index_counts(spark, d):
    chunks = _chunks(spark, d)
    return lookups.counts(chunks.select("file_path"), chunks, _stored(spark, d), _members(spark, d))


_INSPECT = "SELECT s.src AS id, row_number() OVER (PARTITION BY s.src ORDER BY weight DESC, s.dst)::INT AS rank, s.dst AS neighbor, CASE WHEN d.doc_id IS NOT NULL THEN source || '/' || doc_id || '.txt' END AS file_path, round(weight, 6) AS weight FROM sym s LEFT JOIN (SELECT * FROM documents WHERE doc_id % 6 <> 0) d ON d.doc_id = s.dst WHERE s.src % 10 = 0"


@query(_with(*_GRAPH) + _INSPECT)
def inspect_neighbors(spark, d):
    ids = _emb(spark, d).filter("id % 10 = 0").select("id")
    return lookups.inspect_neighbors(_stored(spark, d), _chunks(spark, d).filter("id % 6 <> 0"), ids).drop("line_start", "line_end")


@query(_with(*_GRAPH) + "SELECT doc_id AS id, source || '/' || doc_id || '.txt' AS file_path, n FROM documents LEFT JOIN (SELECT src, count(*)::INT AS n FROM sym GROUP BY src) ON src = doc_id WHERE doc_id % 10 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)")
def inspect_chunk(spark, d):
    ids = _emb(spark, d).filter("id % 10 = 0").select("id")
    found = lookups.inspect_chunks(_stored(spark, d), _chunks(spark, d), ids)
    return found.select("id", "file_path", F.when(F.col("edges").isNotNull(), F.size("edges")).alias("n"))


@query("SELECT source || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash, 1::BIGINT AS chunk_count, doc_id AS id, substr(text, 1, 80) AS preview FROM documents WHERE doc_id % 20 = 0")
def inspect_file(spark, d):
    files = corpus.from_table(_t(spark, d, "documents"))
    paths = _chunks(spark, d).filter("id % 20 = 0").select(F.col("file_path").alias("path"))
    return lookups.inspect_files(files, _chunks(spark, d), paths).drop("line_start", "line_end")


# expansion and evaluation


_ANSWER = "'Sure: ' || '```json' || chr(10) || '{\"queries\": [\" ' || id || ' \", \"\", 5, \"Alpha ' || id || '\", \"alpha ' || id || '\", \"Q' || id || '\", \"beta\", \"gamma\"], \"hyde\": \"' || CASE WHEN id % 2 = 0 THEN ' ' ELSE 'passage' END || '\"}' || chr(10) || '```'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return rows.select(F.col("id").alias("query_id"), F.format_string("q%d", "id").alias("query"), F.when(F.col("id") % 5 == 4, F.lit("no json")).otherwise(F.expr(_ANSWER.replace("chr(10)", "'\\n'"))).alias("raw"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 5 = 4 THEN '' ELSE item_id || '|Alpha ' || item_id || '|beta' END AS variants, CASE WHEN item_id % 5 <> 4 AND item_id % 2 = 1 THEN 'passage' END AS hyde FROM benchmark")
def expand_variants(spark, d):
    return expansion.expand(_answers(spark, d)).withColumn("variants", F.array_join("variants", "|"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 5 <> 4 THEN regexp_extract(a, '(?s)\\{.*\\}') END AS found FROM (SELECT item_id, (" + _ANSWER.replace("id", "item_id") + ") AS a FROM benchmark)")
def extract_json(spark, d):
    return _answers(spark, d).select("query_id", expansion.extract_json("raw").alias("found"))


_TOPDOCS = f"ranked AS (SELECT * FROM (SELECT a.id AS query_id, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY {_SIM} DESC, b.id)::INT AS position FROM q a, e b) WHERE position <= 20)"
_RELEVANT = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text))"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage word for word.

    A passage that lies in a document has its inner words in it as they are, so the two meet by a hash of the passage's first
    three inner words; then the whole passage is looked for. The few passages with fewer inner words are looked for
    in every document.
    """
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _docs(spark, d).select("id", "text")
    split = lambda c: F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    inner = F.transform(split("query"), lambda w: w)
    marked = items.withColumn("ws", inner).withColumn("long", F.size("ws") >= 5)
    anchors = marked.filter("long").select("query_id", "query", F.xxhash64(F.slice("ws", 2, 3)).alias("h"))
    ws = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.xxhash64(F.slice("ws", i, 3)))
    hashed = docs.withColumn("ws", split("text")).filter(F.size("ws") >= 3).select("id", F.explode(F.array_distinct(ws)).alias("h"))
    near = hashed.join(anchors.select("query_id", "h"), "h").select("id", "query_id").distinct()
    hits = near.join(docs, "id").join(items, "query_id").filter(F.contains("text", "query")).select("query_id", "id")
    short = marked.filter("not long").select("query_id", "query")
    if not short.isEmpty():
        hits = hits.unionByName(docs.join(short, F.contains("text", "query")).select("query_id", "id"))
    return items.join(hits.groupBy("query_id").agg(F.collect_list(F.col("id").cast("string")).alias("relevant")), "query_id", "left")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    asked = vectors.hash_embed(_t(spark, d, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), "vector")
    return knn.search_batch(vectors.hash_embed(_docs(spark, d)), asked, 20)


_PERQ = """perq AS (SELECT item_id AS query_id, CASE WHEN count(r.id) = 0 THEN 0.0 ELSE count(*) FILTER (position <= 5)::DOUBLE / count(r.id) END AS recall_5,
CASE WHEN count(r.id) = 0 THEN 0.0 ELSE count(*) FILTER (position <= 10)::DOUBLE / count(r.id) END AS recall_10, coalesce(1.0 / min(position) FILTER (position <= 10), 0.0)::DOUBLE AS mrr
FROM benchmark LEFT JOIN rel r ON r.query_id = item_id LEFT JOIN ranked USING (query_id, id) GROUP BY item_id)"""


def _perq(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_query(_ranked(spark, d).select("query_id", F.col("id").cast("string").alias("file"), F.col("rank").alias("position")), _labels(spark, d))


@query(_with(_embedded("e", "documents", "doc_id"), _embedded("q", "benchmark", "item_id"), _TOPDOCS, _RELEVANT, _PERQ) + "SELECT query_id, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(mrr, 9) AS mrr FROM perq")
def recall_mrr(spark, d):
    return _perq(spark, d).select("query_id", *(F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "mrr")))


@query(_with(_embedded("e", "documents", "doc_id"), _embedded("q", "benchmark", "item_id"), _TOPDOCS, _RELEVANT, _PERQ) + "SELECT 'baseline' AS config, count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr FROM perq")
def eval_baseline(spark, d):
    found = evaluation.summary(_perq(spark, d).withColumn("config", F.lit("baseline")))
    return found.select("config", "queries", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr")))


@query()
def eval_configs(spark, d):
    """Three configurations over the passages that some document holds."""
    from heatgraph.plans.evaluate import run_eval

    labels = _labels(spark, d).filter("relevant is not null").withColumn("relevant", F.transform("relevant", lambda i: i))
    files = _chunks(spark, d).select(F.col("id").cast("string").alias("i"), "file_path")
    named = labels.select("query_id", "query", F.explode("relevant").alias("i")).join(files, "i").groupBy("query_id", "query").agg(F.collect_list("file_path").alias("relevant"))
    return run_eval(_tables(spark, d, True), named, Config(), ("baseline", "graph", "rerank"))


# the whole pipeline


def _tables(spark: SparkSession, d: str, whole: bool) -> dict[str, DataFrame]:
    from heatgraph.checkpoints import cut

    if whole:
        chunks = _chunks(spark, d)
    else:
        parts = chunking.chunk_files(corpus.from_table(_t(spark, d, "documents")))
        chunks = cut(maintenance.assign_ids(parts, 0).drop("pos").select("id", "file_path", "text", "byte_start", "byte_end", "line_start", "line_end"))
    v = cut(vectors.hash_embed(chunks.select("id", "text")))
    lists = edges.knn_edges(v).select("src", "dst", "weight")
    stored = cut(edges.replace_edges(lists.limit(0), lists, v.select("id", F.col("id").alias("ord"))))
    return {"chunks": chunks, "chunk_vectors": v.withColumnRenamed("id", "chunk_id"), "edges": stored}


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query()
def pipeline_query(spark, d):
    found = run_query(_tables(spark, d, False), _passages(spark, d))
    return found.select("query_id", "rank", "id", "file", "line_start", "line_end", F.round("score", 6).alias("score"))


@query()
def pipeline_files(spark, d):
    return ranking.file_scores(run_query(_tables(spark, d, False), _passages(spark, d)))


@query(_with(
    _embedded("e", "documents", "doc_id"), _embedded("q", "benchmark", "item_id"),
    f"dp AS (SELECT a.id AS src, b.id AS dst, {_SIM} AS w FROM e a JOIN e b ON a.id <> b.id)",
    "dk AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM dp WHERE w >= 0.55) WHERE rn <= 8)",
    "edges AS (SELECT dst AS src, src AS dst, w AS weight FROM dk WHERE src > dst)", _BOTH,
    f"sims AS (SELECT a.id AS query_id, b.id, round(greatest(0.0, list_inner_product(a.v, b.v)), 9) AS sim FROM q a, e b)",
    f"seeds AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS heat FROM (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_SIM} DESC, b.id) AS rank FROM q a, e b) WHERE rank <= 20)",
    "heat0 AS (SELECT *, 0 AS hop FROM seeds)", _hop(1, "heat0", "heat0").replace(">= 0.1", ">= 0.35"),
    "filled AS (SELECT h.query_id, h.id, coalesce(s.heat, 0.0) AS vector, h.heat FROM heat1 h LEFT JOIN seeds s USING (query_id, id))",
    f"scaled AS (SELECT query_id, id, {_mm('vector')} AS v1, {_mm('heat')} AS h1 FROM filled WINDOW w AS (PARTITION BY query_id))",
    "scored AS (SELECT query_id, id, (0.25 * h1 + 0.15 * v1) / 0.4 AS score FROM scaled)",
) + "SELECT query_id, rank, id, file, round(score, 6) AS score FROM (SELECT query_id, s.id, d.source || '/' || d.doc_id || '.txt' AS file, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id)::INT AS rank FROM scored s JOIN documents d ON d.doc_id = s.id) WHERE rank <= 8")
def pipeline_whole_documents(spark, d):
    found = run_query(_tables(spark, d, True), _passages(spark, d), Config(), Options(hops=1, exact_order=False))
    return found.select("query_id", "rank", "id", "file", F.round("score", 6).alias("score"))
