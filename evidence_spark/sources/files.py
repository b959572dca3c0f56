"""File scans: word logs, labels, row events, chunks, ledgers and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from evidence_spark import policy, schemas
from evidence_spark.functions import crypto
from evidence_spark.operators.ordered import global_sequence, rolling_count
from evidence_spark.plans.detection import words_to_unified
from evidence_spark.session import scratch_table
from evidence_spark.sources import ranges

FILE_SCHEME = r"^file:/+"


def source_path(column: Column) -> Column:
    """Path of a scanned file; the local scheme is dropped, others are kept."""
    return F.regexp_replace(column, FILE_SCHEME, "/")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar labels of one or many captures; ``source_file`` is the capture a sidecar
    ``<capture>_labels.csv`` belongs to."""
    rows = spark.read.option("header", True).schema(schemas.PACKET_LABELS).csv(path)
    capture = F.regexp_replace(source_path(F.col("_metadata.file_path")), r"_labels\.csv$", ".pcap")
    return rows.select(capture.alias("source_file"), *rows.columns)


def read_word_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw bus words with the offset of each row in its file."""
    rows = spark.read.option("header", True).schema(schemas.WORD_LOG).csv(path)
    return with_file_offset(rows).filter(F.col("raw_hex").isNotNull() | F.col("timestamp").isNotNull())


def read_words_unified(spark: SparkSession, path: str) -> DataFrame:
    """Bus words in the unified schema with the trailing one-second word count."""
    words = read_word_log(spark, path).withColumn("_us", F.round(F.col("timestamp") * 1e6).cast("bigint"))
    words = words.withColumn("_bus", F.lit(policy.WORD_BUS))
    numbered = global_sequence(words, ["source_file", "source_offset"], "_n")
    counted = rolling_count(numbered, ["_bus"], "_us", "_n", 1, "frequency")
    return words_to_unified(counted)


def with_file_offset(rows: DataFrame) -> DataFrame:
    """Add ``source_file`` and the 0-based row number within each file.

    Rows of one file keep their order inside a split, and splits of a file are ordered
    by their start, so per-split counts turn positions into file offsets.
    """
    where = rows.select("*", "_metadata.file_path", "_metadata.file_block_start")
    tagged = where.withColumn("_id", F.monotonically_increasing_id())
    stored = scratch_table(tagged, "rows")
    at = Window.partitionBy("file_path", "file_block_start").orderBy("_id")
    spans = stored.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(upto), F.lit(0))).drop("_rows")
    placed = stored.withColumn("_at", F.row_number().over(at) - 1).join(spans, ["file_path", "file_block_start"])
    return placed.select(*rows.columns, source_path(F.col("file_path")).alias("source_file"), (F.col("_before") + F.col("_at")).cast("bigint").alias("source_offset"))


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """CSV files below ``path`` by their first line; empty files have none and are left out.
    Like Spark's own listing of the input this holds file names, never rows."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    at_start = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").filter("file_block_start = 0")
    first = at_start.withColumn("_id", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "_id").alias("header"))
    kinds: dict[str, list[str]] = {}
    for row in first.orderBy("file_path").collect():
        kinds.setdefault(row["header"], []).append(row["file_path"])
    return kinds


def read_row_events(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """CSV rows as raw events: canonical JSON payload, row number, column list. Files are
    read with their own header. ``multiline`` reads quoted line breaks; such files are
    not split."""
    parts = [_rows_of_kind(spark, files, columns, multiline) for files in files_by_header(spark, path).values()]
    if not parts:
        return spark.createDataFrame([], schemas.RAW_EVENT)
    return reduce(DataFrame.unionByName, parts)


def _rows_of_kind(spark: SparkSession, files: list[str], columns: list[str] | None, multiline: bool) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", multiline).csv(files)
    names = columns or rows.columns
    placed = with_file_offset(rows)
    body = crypto.canonical({n: F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names})
    meta = F.to_json(F.struct(F.array(*(F.lit(n) for n in names)).alias("columns"), F.lit("csv_row").alias("ingest_mode"), F.col("source_offset").alias("row_index")))
    return placed.select(
        "source_file", F.lit("CSV").alias("source_type"), "source_offset", body.cast("binary").alias("payload"), meta.alias("metadata_json")
    )


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = policy.CHUNK_BYTES, glob: str | None = None, skip_csv: bool = False, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Any file cut into payloads of ``chunk_bytes``, with chunk index and size. Files are read in
    ranges of about ``range_bytes``, chunk by chunk, so neither a row nor a task holds a file;
    empty files have no chunk."""
    planned = ranges.file_ranges(spark, path, max(1, range_bytes // chunk_bytes) * chunk_bytes, glob)
    if skip_csv:
        planned = planned.filter(~F.lower("path").endswith(".csv"))
    chunks = ranges.chunks(planned, chunk_bytes)
    suffix = F.upper(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    meta = F.to_json(F.struct(F.col("chunk").cast("int").alias("chunk_index"), F.octet_length("payload").alias("chunk_size"), F.lit("binary_chunk").alias("ingest_mode")))
    return chunks.select(
        source_path(F.col("path")).alias("source_file"), F.when(suffix == "", "BINARY").otherwise(suffix).alias("source_type"),
        F.col("chunk").alias("source_offset"), "payload", meta.alias("metadata_json"),
    )


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder with everything below it: CSV files by row, all others by chunk."""
    return read_row_events(spark, path).unionByName(read_chunks(spark, path, skip_csv=True))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(source_path(F.col("path")).alias("source_file"), F.col("length").alias("size_bytes"), "modificationTime")


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, and a record that
    cannot be read stays as a row of nulls so that verification sees it."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, excerpt_chars: int = 1800) -> DataFrame:
    """One document per text file: name, time, whole text, an excerpt for listings and status."""
    from evidence_spark.operators.retrieval import indexable

    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        source_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("uploaded_at"), F.col("value").alias("text")
    )
    docs = texts.withColumns({"doc_id": F.sha2("path", 256), "name": F.regexp_extract("path", r"([^/]+)$", 1), "excerpt": F.substring("text", 1, excerpt_chars)})
    status = F.when(F.col("text_available"), "text indexed").otherwise("stored without searchable text")
    return indexable(docs).withColumn("context_status", status)
