"""Files by byte range: no row, and no task, holds a whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
#: Tasks at most, whatever the number of ranges; each then reads several.
MOST_TASKS = 100_000


def opened(path: str):
    """A file of the local or any shared store, open for reading at any place."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if ":/" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(path)
    return store.open_input_file(inner)


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, glob: str | None = None) -> DataFrame:
    """(path, length, range, start, stop) of every file below ``path`` that is not empty. Only the
    names and lengths of the files are looked at, so their size is no limit."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length").filter("length > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))).alias("number")
    start = F.col("number") * range_bytes
    return files.select("path", "length", number).select(
        "path", "length", F.col("number").cast("int").alias("range"), start.alias("start"), F.least(start + range_bytes, "length").alias("stop")
    )


def one_task_each(ranges: DataFrame) -> DataFrame:
    """The ranges dealt to as many tasks as there are ranges; rows are too small to tell Spark how
    much work each of them is."""
    return ranges.repartition(max(1, min(MOST_TASKS, ranges.count())), "path", "range")


def chunks(planned: DataFrame, chunk_bytes: int) -> DataFrame:
    """(path, chunk, payload): the bytes of each range in pieces of ``chunk_bytes``, numbered within the
    file. Ranges must begin at multiples of ``chunk_bytes``; the last piece of a file may be shorter."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    source.seek(row["start"])
                    for at in range(row["start"], row["stop"], chunk_bytes):
                        payload = source.read(min(chunk_bytes, row["stop"] - at))
                        yield pa.RecordBatch.from_pydict({"path": [row["path"]], "chunk": pa.array([at // chunk_bytes], pa.int64()), "payload": pa.array([payload], pa.binary())})

    return one_task_each(planned).mapInArrow(run, "path string, chunk long, payload binary")
