"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, optionally partitioned and sorted inside each file for pruning."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append ledger records as JSON lines, nulls written out."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_explanations(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Explained rows as JSON lines in time order across the files."""
    df.orderBy(time).write.mode("errorifexists").json(path)


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("errorifexists").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as its own folder: a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
