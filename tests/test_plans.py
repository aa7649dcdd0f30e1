"""Index, query and evaluation over a small folder of files."""

import pytest

from heatgraph.errors import ManifestError
from heatgraph.operators.maintenance import drift
from heatgraph.operators.ranking import file_scores
from heatgraph.plans.config import Config
from heatgraph.plans.evaluate import run_eval
from heatgraph.plans.index import run_index
from heatgraph.plans.query import Options, run_query
from heatgraph.sources.corpus import labelled_queries, scan_folder
from heatgraph.sources.snapshots import Snapshots

FILES = {
    "pets.md": "# Pets\ndogs and cats are friendly animals that live with people\n",
    "space.md": "# Space\nrockets fly to the moon and to distant planets\r\n",
    "sub/cooking.txt": "soup and bread are cooked in the kitchen with salt\n",
    "sub/.hidden.txt": "a hidden file about the garden and its flowers\n",
    "node_modules/x.txt": "left out",
    ".git/y.txt": "left out",
    "build/z.txt": "left out by the ignore file",
    "sub/heatgraph.toml": "kept below the root",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "heatgraph.toml").write_text("")
    (tmp_path / ".gitignore").write_text("build/\n*.log\n!keep.log\n")
    (tmp_path / "a.log").write_text("ignored")
    (tmp_path / "keep.log").write_text("taken in again")
    (tmp_path / "binary.txt").write_bytes(b"a\0b")
    (tmp_path / "big.txt").write_bytes(b"x" * (2 * 1024 * 1024 + 1))
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 text")
    return tmp_path


def test_scan(spark, folder):
    found = {r["path"]: r["text"] for r in scan_folder(spark, str(folder)).collect()}
    assert set(found) == {"pets.md", "space.md", "sub/cooking.txt", "sub/.hidden.txt", "sub/heatgraph.toml", "keep.log", "bad.txt", ".gitignore"}
    assert found["bad.txt"] == "caf\ufffd text" and "\r" not in found["space.md"]
    only = {r["path"] for r in scan_folder(spark, str(folder), ["*.md", "sub/**"], ["sub/.hidden*"]).collect()}
    assert only == {"pets.md", "space.md", "sub/cooking.txt", "sub/heatgraph.toml"}
    assert "a.log" in {r["path"] for r in scan_folder(spark, str(folder), respect_gitignore=False).collect()}


def test_index_and_query(spark, folder, tmp_path_factory):
    store = Snapshots(spark, str(tmp_path_factory.mktemp("index")))
    scan = lambda: scan_folder(spark, str(folder), ["*.md", "*.txt"])
    config = Config().set("graph.min_edge_sim", 0.05).set("graph.query_floor", 0.0)
    first = run_index(store, scan(), config).first().asDict()
    assert (first["indexed"], first["unchanged"], first["deleted"]) == (5, 0, 0)
    again = run_index(store, scan(), config).first().asDict()
    assert (again["indexed"], again["unchanged"]) == (0, 5)
    before = {r["id"] for r in store.table("chunks").collect()}
    (folder / "pets.md").write_text("# Pets\nparrots talk and sing all day\n")
    (folder / "space.md").unlink()
    (folder / "new.txt").write_text("trains run on rails between the towns\n")
    assert drift(store.table("files"), scan()).first().asDict() == {"new": 1, "changed": 1, "deleted": 1}
    third = run_index(store, scan(), config).first().asDict()
    assert (third["indexed"], third["unchanged"], third["deleted"]) == (2, 3, 1)
    tables = store.tables()
    now = {r["id"]: r["file_path"] for r in tables["chunks"].collect()}
    assert min(i for i, f in now.items() if f in ("pets.md", "new.txt")) > max(before)
    ends = {n for r in tables["edges"].collect() for n in (r["src"], r["dst"])}
    assert ends <= set(now) and {r["chunk_id"] for r in tables["chunk_vectors"].collect()} == set(now)
    assert {r["chunk_id"] for r in tables["communities"].collect()} == ends
    queries = spark.createDataFrame([(1, "parrots sing"), (2, "soup in the kitchen")], "query_id long, query string")
    found = run_query(tables, queries, config, Options(explain=True)).collect()
    best = {r["query_id"]: r["file"] for r in found if r["rank"] == 1}
    assert best == {1: "pets.md", 2: "sub/cooking.txt"}
    alone = run_query(tables, queries.filter("query_id = 2"), config, Options(explain=True)).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in found if r["query_id"] == 2)
    with pytest.raises(ManifestError):
        run_index(store, scan(), config.set("chunking.size_tokens", 400))
    assert run_index(store, scan(), config.set("chunking.size_tokens", 400), full=True).first()["indexed"] == 5
    labels = folder / "labels.jsonl"
    labels.write_text('{"query": "parrots sing", "relevant_files": ["pets.md"]}\n\n{"query": "trains", "relevant_files": ["new.txt"]}\n')
    rows = {r["config"]: r for r in run_eval(store.tables(), labelled_queries(spark, str(labels)), config, ("baseline", "rerank")).collect()}
    assert rows["baseline"]["queries"] == 2 and rows["baseline"]["mrr"] == 1.0 and rows["rerank"]["recall_5"] == 1.0
    labels.write_text('{"query": "x", "relevant_files": []}\nnot json\n')
    with pytest.raises(Exception, match="line 2"):
        labelled_queries(spark, str(labels)).collect()


def test_empty_index(spark, tmp_path):
    queries = spark.createDataFrame([(1, "anything")], "query_id long, query string")
    found = run_query(Snapshots(spark, str(tmp_path)).tables(), queries)
    assert found.count() == 0 and file_scores(found).count() == 0
