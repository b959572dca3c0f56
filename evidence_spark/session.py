"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "evidence_spark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (all of them overridable)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine; on a
    cluster such a folder would be lost together with its executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="evidence_spark_")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so writes cannot collide."""
    path = f"{scratch_root(spark)}/evidence_spark/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was written for queries inside; results must be used up or
    stored elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written[before:]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        del _written[before:]


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is consumed several times and must be the same each time, or
    where an iteration would otherwise grow its lineage. Parquet keeps column pruning
    and min/max filtering for the readers, and the files outlive lost executors. Hex hashes
    fill most of a log; zstd halves them, the default codec keeps them as they are.
    """
    return _stored(df, scratch_path(df.sparkSession, label))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_result(spark: SparkSession, made: Callable[[], DataFrame], label: str) -> DataFrame:
    """``scratch_table`` of what ``made`` returns. The tables that ``made`` itself stored are
    removed as soon as the result is, so they do not add up over the steps of a longer job."""
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        return _stored(made(), path)


def sized(df: DataFrame, label: str) -> DataFrame:
    """Store the small side of a join, one row per group, so that the optimizer knows its
    true size: below the broadcast threshold it is broadcast and the large side is not
    shuffled by a handful of keys; above it the join is an ordinary shuffle join. An
    aggregate that is joined directly is planned with the size of its input instead."""
    return scratch_table(df, label)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a costly stage over a small input. Inputs with at least one
    partition per core, which is every large one, pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
