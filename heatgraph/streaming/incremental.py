"""Keeping an index up to date from a stream of files (an extension: each batch is an ordinary incremental build)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heatgraph.functions.providers import Embedder
from heatgraph.plans.config import Config
from heatgraph.plans.index import run_index
from heatgraph.sources.snapshots import Snapshots


def index_stream(files: DataFrame, store: Snapshots, checkpoint: str, config: Config = Config(), embedder: Embedder | None = None) -> StreamingQuery:
    """Applies each batch of ``files(path, content_hash, mtime, text)`` to the index in ``store``.

    A null text deletes the file. The last row of a path in a batch (by mtime) counts. Files that a batch doesn't name
    stand in the build with the hash the index has of them, so their texts are neither kept beside the index nor read again. A
    batch that is repeated after a failure finds its files unchanged, so it adds nothing twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("content_hash", "mtime", "text"), "mtime").alias("r")).select("path", "r.*")
        known = store.table("files").select("path", "content_hash", "mtime", F.lit(None).cast("string").alias("text"))
        now = known.join(last.select("path"), "path", "left_anti").unionByName(last.filter("text is not null"))
        run_index(store, now, config, embedder)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
