"""Streaming queries: the events table as a file stream, read until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import registry as sql_functions
from evidence_spark.plans import oracle as o
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.registry import query
from evidence_spark.session import scratch_path
from evidence_spark.sources.sinks import write_batch
from evidence_spark.streaming import keyed, live


def _timed(spark, sf):
    return proxy.evidence_of(proxy.event_stream(spark, sf)).withColumn("at", F.timestamp_micros("occurred_us"))


def _collected(spark, stream, keys):
    """Run an aggregating stream in update mode and read the newest row per key."""
    out = scratch_path(spark, "stream-out")
    live.run_available(stream, lambda batch, batch_id: write_batch(batch, out, batch_id), scratch_path(spark, "stream-state"), "update")
    return live.latest_by_key(spark.read.parquet(out), keys)


@query("stream_trend", with_ev(f"""SELECT CAST(occurred_us // 60000000 * 60000000 AS BIGINT) AS bucket_us, count(*) FILTER ({o.severity_rank('severity')} >= 3) AS high,
    count(*) FILTER ({o.severity_rank('severity')} = 2) AS medium, count(*) FILTER ({o.severity_rank('severity')} < 2) AS low FROM ev WHERE predicted_anomaly = 1 GROUP BY 1"""))
def stream_trend(spark, sf):
    return _collected(spark, live.stream_severity_trend(_timed(spark, sf), "at"), ["bucket_us"])


@query("stream_counts", with_ev("SELECT domain, CAST(occurred_us // 1000000 * 1000000 AS BIGINT) AS start_us, count(*) AS rows FROM ev GROUP BY ALL"))
def stream_counts(spark, sf):
    return _collected(spark, live.stream_rate_counts(_timed(spark, sf), "domain", "at"), ["domain", "start_us"])


@query("stream_arrival_rate", with_ev("""SELECT sequence, domain, round(coalesce(rate, median(rate) OVER (PARTITION BY domain)), 9) AS frequency, false AS late
    FROM (SELECT sequence, domain, CASE WHEN before IS NOT NULL THEN least(1 / greatest(CAST(occurred_us - before AS DOUBLE) / 1000000, 0.0001), 10000) END AS rate
      FROM (SELECT *, lag(occurred_us) OVER (PARTITION BY domain ORDER BY occurred_us, sequence) AS before FROM ev))"""))
def stream_arrival_rate(spark, sf):
    root = scratch_path(spark, "stream-rates")
    live.stream_arrival_rate(_timed(spark, sf), root, scratch_path(spark, "stream-state"))
    return spark.read.parquet(f"{root}/rates").select("sequence", "domain", F.round("frequency", 9).alias("frequency"), "late")


@query("live_intake", with_ev("""SELECT row_number() OVER (ORDER BY source_file, source_offset) AS sequence, source_file, source_offset, sha256(payload) AS payload_sha256,
    row_number() OVER (ORDER BY source_file, source_offset) AS evidence_id, predicted_anomaly, severity, true AS batch_ok FROM logsrc"""))
def live_intake(spark, sf):
    """Sealed log joined to the evidence written with it, and the verification result."""
    ev = proxy.evidence_of(proxy.event_stream(spark, sf))
    records = ev.select(
        "source_file", "source_type", "source_offset", proxy.payload(ev).alias("payload"),
        F.to_json(F.struct("anomaly_score", "predicted_anomaly", "severity")).alias("verdict"),
        F.lit("normal").alias("scenario"), F.col("occurred_at").alias("recorded_at"),
    )
    root = scratch_path(spark, "intake")
    live.live_intake(records, root, scratch_path(spark, "stream-state"), "test-key")
    ok = live.verify_new_batches(spark, root, "test-key").select("batch_id", F.col("ok").alias("batch_ok"))
    log = spark.read.parquet(f"{root}/log").join(ok, "batch_id").select("sequence", "source_file", "source_offset", "payload_sha256", "batch_ok")
    return log.join(spark.read.parquet(f"{root}/evidence").select("sequence", "evidence_id", "predicted_anomaly", "severity"), "sequence")


@query("sql_functions", with_ev(f"""SELECT event_id, CASE WHEN src LIKE '192.168.1.%' THEN 'cabin' WHEN src LIKE '192.168.2.%' THEN 'maintenance' ELSE 'afdx' END AS zone,
    severity AS band, {o.risk('anomaly_score', 'severity')} AS risk, CAST(bit_count(CAST(raw_hex AS BIGINT)) % 2 AS INTEGER) AS parity, {o.slug('target', 'dst')} AS node FROM ev"""))
def sql_functions_query(spark, sf):
    """The rules under their SQL names."""
    sql_functions.register(spark)
    proxy.evidence(spark, sf).createOrReplaceTempView("evidence_events")
    return spark.sql(
        "SELECT event_id, ip_domain(src) AS zone, severity_band(anomaly_score) AS band, risk_score(anomaly_score, severity) AS risk, "
        "parity_valid(raw_hex) AS parity, node_slug('target', dst) AS node FROM evidence_events"
    )


# --- several deliveries: the same events come in four quarters of their time, the stream stops after each

def _in_deliveries(spark, sf, run):
    """Call ``run(stream)`` after each delivery; a delivery has as many files as its scan has partitions."""
    path, ev = scratch_path(spark, "deliveries"), proxy.evidence(spark, sf)
    first, last = ev.agg(F.min("occurred_us"), F.max("occurred_us")).first()
    span = (0 if first is None else last - first) + 1
    quarter = F.coalesce(F.floor((F.col("occurred_us") - F.lit(first or 0)) * 4 / F.lit(span)), F.lit(0))
    for number in range(4):
        ev.filter(quarter == number).write.mode("append").parquet(path)
        run(spark.readStream.schema(ev.schema).parquet(path))


QUARTER = "(occurred_us - min(occurred_us) OVER ()) * 4 // (max(occurred_us) OVER () - min(occurred_us) OVER () + 1)"


@query("stream_keyed_rate", with_ev("""SELECT sequence, domain, round(coalesce(rate, median(rate) OVER (PARTITION BY domain)), 9) AS frequency, false AS late
    FROM (SELECT sequence, domain, CASE WHEN before IS NOT NULL THEN least(1 / greatest(CAST(occurred_us - before AS DOUBLE) / 1000000, 0.0001), 10000) END AS rate
      FROM (SELECT *, lag(occurred_us) OVER (PARTITION BY domain ORDER BY occurred_us, sequence) AS before FROM ev))"""))
def stream_keyed_rate(spark, sf):
    """Arrival rates of four deliveries with state kept by the stream from one run to the next."""
    out, state = scratch_path(spark, "stream-gaps"), scratch_path(spark, "stream-state")

    def run(stream):
        gaps = keyed.stream_gaps(stream, "domain", "occurred_us", "sequence", slot_us=24 * 3_600_000_000)
        keyed.collect_gaps(gaps, out, state)

    _in_deliveries(spark, sf, run)
    rates = keyed.complete_rates(spark.read.parquet(out), "domain", "occurred_us", "sequence")
    return rates.select("sequence", "domain", F.round("frequency", 9).alias("frequency"), "late")


@query("stream_counts_restarted", with_ev("SELECT domain, CAST(occurred_us // 1000000 * 1000000 AS BIGINT) AS start_us, count(*) AS rows FROM ev GROUP BY ALL"))
def stream_counts_restarted(spark, sf):
    """Counts per second of four deliveries, open windows carried from run to run."""
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")

    def run(stream):
        timed = stream.withColumn("at", F.timestamp_micros("occurred_us"))
        live.run_available(live.stream_rate_counts(timed, "domain", "at"), lambda batch, batch_id: write_batch(batch, out, batch_id), state, "update")

    _in_deliveries(spark, sf, run)
    return live.latest_by_key(spark.read.parquet(out), ["domain", "start_us"])


@query("live_intake_batches", with_ev(f"""SELECT row_number() OVER (ORDER BY quarter, source_file, source_offset) AS sequence, source_file, source_offset, true AS batch_ok
    FROM (SELECT source_file, source_offset, {QUARTER} AS quarter FROM ev)"""))
def live_intake_batches(spark, sf):
    """Four deliveries sealed as four linked batches, each verified as it comes."""
    root, state = scratch_path(spark, "intake"), scratch_path(spark, "stream-state")

    def run(stream):
        records = stream.select(
            "source_file", "source_type", "source_offset", proxy.payload(stream).alias("payload"), F.lit(None).cast("string").alias("verdict"),
            F.lit("normal").alias("scenario"), F.col("occurred_at").alias("recorded_at"),
        )
        live.live_intake(records, root, state, "test-key")
        live.verify_new_batches(spark, root, "test-key")

    _in_deliveries(spark, sf, run)
    ok = live.read_batches(spark, f"{root}/verified").select("batch_id", F.col("ok").alias("batch_ok"))
    return spark.read.parquet(f"{root}/log").join(ok, "batch_id").select("sequence", "source_file", "source_offset", "batch_ok")
