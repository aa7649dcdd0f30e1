"""Lineage cuts that every executor can read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from heatgraph.errors import ConfigError


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named by ``spark.checkpoint.dir``.

    Where none is set, one is made in local mode (tests); on a cluster that is an error, as its executors don't share
    the driver's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), sc.master))


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder of the session's setting; a new one where none is set and the master is a single process."""
    if named:
        return named
    if master != "local" and not master.startswith("local["):
        raise ConfigError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns the reread rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
