"""Session helpers: tables, checkpoints, partition counts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; columns prune and filters push down as usual."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: the cluster's ``spark.checkpoint.dir``. Where it is unset a local one is set on a single machine
    (tests); on a cluster, where no other machine would see it, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "lorekiln-checkpoints")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with ``checkpoint()`` in the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes
    a checkpoint when nothing refers to it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each side by side, without a join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions by key only where the input has fewer splits than the cluster has cores (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])
