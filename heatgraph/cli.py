"""Commands: init, index, query, status, config, eval, inspect. Each prints one JSON document; exit codes are 0, 1 (nothing found) and 2 (error)."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping
from pathlib import Path
from typing import TYPE_CHECKING

from heatgraph.errors import HeatgraphError
from heatgraph.plans import config as cfg

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def _emit(doc: object) -> None:
    print(json.dumps(doc, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="heatgraph")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("index").add_argument("--full", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("text", help="the query, or - for standard input")
    for flag in ("--expand", "--no-graph", "--rerank", "--explain", "--files"):
        q.add_argument(flag, action="store_true")
    q.add_argument("--top", type=int)
    q.add_argument("--hops", type=int)
    sub.add_parser("status")
    c = sub.add_parser("config")
    c.add_argument("name")
    c.add_argument("value", nargs="?")
    e = sub.add_parser("eval")
    e.add_argument("labels")
    e.add_argument("--configs", default=",".join(("baseline", "graph", "full")))
    i = sub.add_parser("inspect").add_subparsers(dest="what", required=True)
    for what, kind in (("chunk", int), ("file", str), ("neighbors", int), ("community", int)):
        i.add_parser(what).add_argument("key", type=kind)
    i.add_parser("communities")
    a = p.parse_args(argv)
    try:
        return _run(a)
    except HeatgraphError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    if a.command == "init":
        path = Path(cfg.FILE)
        if path.exists():
            raise HeatgraphError(f"{path} exists")
        path.write_text(cfg.dump(cfg.Config()), "utf-8")
        _emit({"schema": "heatgraph.init.v1", "file": str(path)})
        return 0
    root = cfg.find_root(".")
    config, notes = cfg.load(Path.home() / ".heatgraphrc", root / cfg.FILE)
    for n in notes:
        print(f"warning: {n}", file=sys.stderr)
    if a.command == "config":
        if a.value is not None:
            config = cfg.load(root / cfg.FILE)[0].set(a.name, a.value)
            (root / cfg.FILE).write_text(cfg.dump(config), "utf-8")
        _emit({"schema": "heatgraph.config.v1", "name": a.name, "value": config.get(a.name)})
        return 0

    from pyspark.sql import SparkSession

    from heatgraph.functions.providers import make
    from heatgraph.operators.lookups import counts
    from heatgraph.operators.maintenance import drift
    from heatgraph.operators.ranking import file_scores, result_json
    from heatgraph.plans.evaluate import run_eval
    from heatgraph.plans.index import run_index
    from heatgraph.plans.query import Options, check_model, run_query
    from heatgraph.sources.corpus import labelled_queries, scan_folder
    from heatgraph.sources.snapshots import Snapshots

    spark = SparkSession.builder.appName("heatgraph").getOrCreate()
    store = Snapshots(spark, str(root / ".heatgraph"))
    models = {k: make(k, vars(getattr(config, k)) | {}) for k in ("embedder", "generator", "reranker")}
    scan = lambda: scan_folder(spark, str(root), config.corpus.include, config.corpus.exclude, config.corpus.respect_gitignore)
    if a.command == "index":
        _emit({"schema": "heatgraph.index.v1", **run_index(store, scan(), config, models["embedder"], a.full).first().asDict()})
        return 0
    tables = store.tables()
    if a.command == "status":
        about = counts(tables["files"], tables["chunks"], tables["edges"], tables["communities"]).first().asDict()
        _emit({"schema": "heatgraph.status.v1", **about, "drift": drift(tables["files"], scan()).first().asDict()})
        return 0
    if a.command == "inspect":
        doc, found = _inspect(spark, tables, a.what, getattr(a, "key", None))
        _emit({"schema": f"heatgraph.inspect.{a.what}.v1", **doc})
        return 0 if found else 1
    check_model(store.manifest(), config)
    if a.command == "eval":
        rows = run_eval(tables, labelled_queries(spark, a.labels), config, tuple(a.configs.split(",")), **models).collect()
        _emit({"schema": "heatgraph.eval.v1", "configs": [r.asDict() for r in rows]})
        return 0
    text = sys.stdin.read() if a.text == "-" else a.text
    options = Options(a.top or config.output.top, a.expand, not a.no_graph, a.rerank, a.hops, a.explain)
    queries = spark.createDataFrame([(0, text)], "query_id long, query string")
    found = run_query(tables, queries, config, options, **models)
    if a.files:
        rows = [r.asDict() for r in file_scores(found).orderBy("position").collect()]
        _emit({"schema": "heatgraph.files.v1", "query": text, "files": [{k: r[k] for k in ("file", "score", "chunk_ids")} for r in rows]})
        return 0 if rows else 1
    rows = result_json(found, config.output.max_chunk_chars).collect()
    print(rows[0]["json"] if rows else json.dumps({"schema": "heatgraph.query.v1", "query": text, "results": []}))
    return 0 if rows else 1


def _inspect(spark: SparkSession, tables: Mapping[str, DataFrame], what: str, key: int | str | None) -> tuple[dict, bool]:
    """One document, and whether it has something to show. An unknown chunk, file or community is an error."""
    from heatgraph.operators import communities, lookups

    chunks, edges, members = tables["chunks"], tables["edges"], tables["communities"]
    if what == "communities":
        rows = [r.asDict() for r in communities.community_preview(members, chunks).orderBy("size", "community_id", ascending=[False, True]).collect()]
        return {"count": len(rows), "communities": rows}, bool(rows)
    if what == "community":
        rows = [{"id": r["chunk_id"], "file": r["file_path"], "line_start": r["line_start"], "line_end": r["line_end"]} for r in lookups.community_members(members, chunks, key).collect()]
        if not rows:
            raise HeatgraphError(f"there is no community {key}")
        return {"community_id": key, "size": len(rows), "members": rows}, True
    if what == "file":
        record = tables["files"].filter(tables["files"]["path"] == key).first()
        if record is None:
            raise HeatgraphError(f"there is no file {key}")
        own = lookups.inspect_files(tables["files"], chunks, spark.createDataFrame([(key,)], "path string")).orderBy("id").collect()
        rows = [{c: r[c] for c in ("id", "line_start", "line_end", "preview")} for r in own]
        return {"path": key, "content_hash": record["content_hash"], "chunk_count": len(rows), "chunks": rows}, bool(rows)
    chunk = chunks.filter(chunks["id"] == key).first()
    if chunk is None:
        raise HeatgraphError(f"there is no chunk {key}")
    near = lookups.inspect_neighbors(edges, chunks, spark.createDataFrame([(key,)], "id long")).orderBy("rank").collect()
    rows = [{"id": r["neighbor"], "weight": r["weight"], "file": r["file_path"], "line_start": r["line_start"], "line_end": r["line_end"]} for r in near]
    if what == "neighbors":
        return {"id": key, "neighbors": rows}, bool(rows)
    about = {c: chunk[c] for c in ("byte_start", "byte_end", "line_start", "line_end", "text")}
    return {"id": key, "file": chunk["file_path"], **about, "edges": rows}, bool(rows)


if __name__ == "__main__":
    sys.exit(main())
