"""Structured Streaming: intake, rates, scoring and trends.

Batch writers replace the folder of their own batch id, so a batch that runs again after
a failure leaves the tables as if it had run once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators import evidence, forest, integrity
from evidence_spark.operators.filters import flagged
from evidence_spark.operators.ordered import exact_percentile, ordered_lag, rate_of_gap
from evidence_spark.session import scratch_table, sized
from evidence_spark.sources.sinks import write_batch


def run_available(stream: DataFrame, handle, checkpoint: str, mode: str = "append"):
    """Process everything that is available now, in micro-batches, and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches of a table; None while there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:  # the table appears with its first batch
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """One batch of a table, without looking at the others; None where there is none."""
    return read_batches(spark, f"{path}/batch_id={batch_id}")


def latest_by_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key of a table written in update mode."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    chosen = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_r"))
    return chosen.select(*keys, "_r.*")


# --- intake ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class IntakeTables:
    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


HEADS = StructType([
    StructField("head_hash", StringType()), StructField("last_sequence", LongType()),
    StructField("last_evidence_id", LongType()), StructField("checkpoint_hash", StringType()),
    StructField("checkpoints", LongType()), StructField("committed_at", StringType()),
])


def _last_head(spark: SparkSession, tables: IntakeTables, batch_id: int) -> tuple:
    """The head after the batch before; every batch leaves one, also an empty or rejected one."""
    heads = read_batch(spark, tables.heads, batch_id - 1)
    row = None if heads is None else heads.first()
    if row is None:
        return policy.GENESIS_HASH, 0, 0, policy.GENESIS_HASH, 0, None
    return tuple(row[n] for n in HEADS.names)


def _write_head(spark: SparkSession, tables: IntakeTables, batch_id: int, head: tuple) -> None:
    write_batch(spark.createDataFrame([head], HEADS), tables.heads, batch_id)


def intake_batch(batch: DataFrame, batch_id: int, root: str, key_id: str = "", segment_rows: int = 4096) -> str:
    """Validate one batch and append it: log, evidence, checkpoint and the new head.

    A batch with an unreadable record, or one that mixes scored and raw records, is
    written to ``rejects`` as a whole. Late rows are sealed like all others.
    """
    spark, tables = batch.sparkSession, IntakeTables(root)
    records = scratch_table(batch, "intake")
    readable = F.col("payload").isNotNull() & F.trim("payload").startswith("{") & F.get_json_object("payload", "$").isNotNull()
    counts = records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(readable, F.lit(False))).alias("bad"),
        F.count("verdict").alias("scored"), F.max("recorded_at").alias("at"),
    ).first()
    before = _last_head(spark, tables, batch_id)
    if counts["n"] == 0:
        _write_head(spark, tables, batch_id, before)
        return "empty"
    if counts["bad"] or 0 < counts["scored"] < counts["n"]:
        reason = "unreadable payload" if counts["bad"] else "scored and raw records mixed"
        write_batch(records.withColumn("reason", F.lit(reason)), tables.rejects, batch_id)
        _write_head(spark, tables, batch_id, before)
        return reason
    head, last_sequence, last_evidence, checkpoint_hash, checkpoints, _ = before
    field = lambda path: F.get_json_object("payload", path)
    meta = F.to_json(F.struct(
        scalars.filled(field("$.anomaly_type")).alias("anomaly_type"), scalars.filled(field("$.data_format")).alias("data_format"),
        scalars.filled(field("$.domain")).alias("domain"), F.lit("live_traffic").alias("ingest_mode"),
        scalars.filled(field("$.timestamp")).alias("occurred_at"), scalars.filled(F.col("scenario")).alias("scenario"),
    ))
    raw = records.select(
        F.coalesce(scalars.filled(F.trim("source_file")), F.lit("live://intake")).alias("source_file"),
        F.coalesce(scalars.filled(F.col("source_type")), F.lit("LIVE_TRAFFIC")).alias("source_type"),
        "source_offset", meta.alias("metadata_json"), F.col("payload").cast("binary").alias("payload"),
        F.col("recorded_at").alias("created_at"), "verdict",
    )
    sealed = integrity.seal(raw, ["source_file", "source_offset", "created_at"], head, segment_rows, last_sequence + 1, key_id, "batch")
    write_batch(sealed.rows.drop("verdict"), tables.log, batch_id)
    write_batch(sealed.segments, tables.segments, batch_id)
    if counts["scored"]:
        mapped = sealed.rows.select(
            "source_file", "source_offset", "sequence", "entry_hash", F.col("created_at").alias("recorded_at"),
            F.col("verdict").alias("verdict_json"), F.col("source_file").alias("ai_artifact_path"), F.col("source_offset").alias("ai_artifact_row_index"),
        )
        rows = scratch_table(evidence.evidence_rows(mapped, last_evidence + 1), "evidence")
        write_batch(rows, tables.evidence, batch_id)
        done = integrity.checkpoint(
            rows.withColumn("_cp", F.lit(checkpoints + 1)), "_cp", counts["at"] or "", "live_batch", checkpoint_hash, checkpoints + 1
        )
        stored = scratch_table(done.records, "checkpoint")
        write_batch(stored, tables.checkpoints, batch_id)
        write_batch(done.members, tables.members, batch_id)
        last_evidence += counts["n"]
        checkpoint_hash, checkpoints = stored.first()["ledger_hash"], checkpoints + 1
    new_head = (sealed.head.first()["head_hash"], last_sequence + counts["n"], last_evidence, checkpoint_hash, checkpoints, counts["at"])
    _write_head(spark, tables, batch_id, new_head)
    return "sealed"


def live_intake(stream: DataFrame, root: str, checkpoint: str, key_id: str = "", segment_rows: int = 4096):
    """Seal every micro-batch of live records, in order of their batch ids."""
    return run_available(stream, lambda batch, batch_id: intake_batch(batch, batch_id, root, key_id, segment_rows) and None, checkpoint)


def verify_new_batches(spark: SparkSession, root: str, key_id: str) -> DataFrame:
    """Verify the sealed batches that have no result yet, all in one plan, and store one row
    for each; the trust gate then reads this small table instead of the log. A batch starts
    from the head that the batch before it left."""
    tables = IntakeTables(root)
    segments = read_batches(spark, tables.segments)
    known = read_batches(spark, tables.verified)
    todo = segments.select("batch_id").distinct()
    if known is not None:
        todo = todo.join(known.select("batch_id"), "batch_id", "left_anti")
    todo = sized(todo, "unverified")
    if todo.isEmpty():
        return known
    ends = read_batches(spark, tables.heads).select((F.col("batch_id") + 1).alias("batch_id"), F.col("head_hash").alias("previous_head"))
    heads = todo.join(ends, "batch_id", "left").select("batch_id", F.coalesce("previous_head", F.lit(policy.GENESIS_HASH)).alias("previous_head"))
    done = integrity.verify_logs(read_batches(spark, tables.log), key_id, segments, heads, "batch_id")
    # one file for each batch; a run that fails stores nothing and is done again
    done.repartition("batch_id").write.mode("append").partitionBy("batch_id").parquet(tables.verified)
    return read_batches(spark, tables.verified)


def intake_liveness(heads: DataFrame, now_us: int, seconds: int = 5) -> DataFrame:
    """One row: whether the last batch came within ``seconds`` before ``now``."""
    last = F.max(F.unix_micros(scalars.parse_time(F.col("committed_at"))))
    return heads.agg(last.alias("last_us")).select(
        ((F.lit(now_us) - F.col("last_us")) / F.lit(1e6)).alias("seconds_since_last_batch"),
        F.coalesce(F.lit(now_us) - F.col("last_us") <= seconds * 1_000_000, F.lit(False)).alias("active"),
    )


# --- rates, scores, trends ------------------------------------------------------------------------

def rate_batch(batch: DataFrame, batch_id: int, root: str, key: str, time_us: str, tie: str) -> None:
    """Arrival rates of one batch. The carried state is one row per key (its last time),
    merged and written anew with every batch, so only that of the batch before is read; the rows themselves go through the range-partitioned lag, so one busy key is no
    bottleneck. A row older than the carried time is late: its rate is null."""
    spark = batch.sparkSession
    tables = IntakeTables(root)
    rows = scratch_table(batch.select(key, time_us, tie), "rates")
    carried = read_batch(spark, tables.state, batch_id - 1)
    if carried is None:
        carried = spark.createDataFrame([], StructType([rows.schema[key], StructField("last_us", LongType())]))
    carried = scratch_table(carried, "carried")
    known = rows.join(carried, key, "left").withColumn("_late", F.coalesce(F.col(time_us) < F.col("last_us"), F.lit(False)))
    fresh = ordered_lag(known.filter(~F.col("_late")), [key], [time_us, tie], [time_us])
    before = F.coalesce(f"prev_{time_us}", "last_us")
    gap = (F.col(time_us) - before) / F.lit(1e6)
    rated = scratch_table(fresh.withColumn("_rate", rate_of_gap(gap)), "rated")
    medians = exact_percentile(rated, [key], "_rate", 0.5, "_median")
    out = rated.join(sized(medians, "medians"), key, "left").select(key, time_us, tie, F.coalesce("_rate", "_median").alias("frequency"), F.lit(False).alias("late"))
    late = known.filter("_late").select(key, time_us, tie, F.lit(None).cast("double").alias("frequency"), F.lit(True).alias("late"))
    write_batch(out.unionByName(late), tables.rates, batch_id)
    state = carried.unionByName(rows.select(key, F.col(time_us).alias("last_us")))
    write_batch(state.groupBy(key).agg(F.max("last_us").alias("last_us")), tables.state, batch_id)


def stream_arrival_rate(stream: DataFrame, root: str, checkpoint: str, key: str = "domain", time_us: str = "occurred_us", tie: str = "sequence"):
    return run_available(stream, lambda batch, batch_id: rate_batch(batch, batch_id, root, key, time_us, tie), checkpoint)


def stream_rate_counts(stream: DataFrame, key: str, time: str, watermark: str = "10 minutes", width: str = "1 second") -> DataFrame:
    """Rows per key and tumbling window; rows behind the watermark are not counted."""
    return stream.withWatermark(time, watermark).groupBy(key, F.window(time, width).alias("w")).agg(
        F.count(F.lit(1)).alias("rows")
    ).select(key, F.unix_micros("w.start").alias("start_us"), "rows")


def stream_severity_trend(stream: DataFrame, time: str, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    rank = scalars.severity_rank(F.col("severity"))
    return flagged(stream).withWatermark(time, watermark).groupBy(F.window(time, width).alias("w")).agg(
        F.count_if(rank >= 3).alias("high"), F.count_if(rank == 2).alias("medium"), F.count_if(rank < 2).alias("low")
    ).select(F.unix_micros("w.start").alias("bucket_us"), "high", "medium", "low")


def score_stream(stream: DataFrame, model: forest.Forest, stats: DataFrame) -> DataFrame:
    """Flags, features and scores of packet rows; no state between rows."""
    features = forest.packet_features(scalars.security_flags(stream), stats)
    return forest.score_forest(features, model, "domain", F.lit(policy.PACKET_FORMAT))


