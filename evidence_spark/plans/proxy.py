"""Evidence tables derived from the supplied ``events`` table.

The columns follow the shapes in FIXTURES.md. Everything is integer arithmetic on the
event fields, so the same values can be computed in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions import crypto
from evidence_spark.operators import integrity
from evidence_spark.session import spread

DOMAINS = ["cabin", "maintenance", "afdx", "avionics", "integrity"]
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    seconds = f"cast(cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6))"
    return F.expr(f"cast({seconds} * 1000000 as bigint)")


def _by_index(index: Column, values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored evidence events, one row per input event. The table packs many events into few
    file splits, so its short rows are spread before each becomes a long one."""
    return evidence_of(spread(table(spark, sf_dir, "events")))


def event_stream(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).options(pathGlobFilter="events.parquet", **options).parquet(sf_dir)
    return rows.repartition(spark.sparkContext.defaultParallelism)


SCORE_BANDS = "CASE WHEN anomaly_score < -0.1D THEN 'HIGH' WHEN anomaly_score < 0 THEN 'MEDIUM' WHEN anomaly_score < 0.05D THEN 'LOW' ELSE 'NONE' END"
LABELLED = "(cents > 15000 OR k % 25 = 0)"


def _names(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pick_sql(values: list[str], index: str) -> str:
    return f"element_at({_names(values)}, cast({index} as int) + 1)"


def _address_sql(domain: str, number: str) -> str:
    host = f"({number} % 254 + 1)"
    return f"CASE {domain} WHEN 'cabin' THEN concat('192.168.1.', {host}) WHEN 'maintenance' THEN concat('192.168.2.', {host}) ELSE concat('10.0.', {number} % 256, '.', {host}) END"


EVIDENCE_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "k": "k",
    "cents": "cents",
    "sequence": "event_id + 1",
    "evidence_id": "event_id + 1",
    "source_file": "concat('events/', event_type, '.csv')",
    "source_type": "CASE WHEN domain = 'integrity' THEN 'SECURITY_EVENT' ELSE 'CSV' END",
    "source_offset": "event_id",
    "occurred_us": "cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6)) * 1000000 as bigint)",
    "occurred_at": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "domain": "domain",
    "data_format": "CASE domain WHEN 'avionics' THEN 'ARINC429' WHEN 'integrity' THEN 'LOG' ELSE 'PCAP' END",
    "src": _address_sql("domain", "user_id"),
    "dst": _address_sql("dst_domain", "(user_id * 7)"),
    "port": "cast(element_at(array(80, 443, 8080, 22, 102, 502, 7100, 161), cast(k % 8 as int) + 1) as bigint)",
    "protocol": "CASE WHEN k % 20 = 0 THEN 'ICMP' WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END",
    "packet_size": "cents div 10",
    "frequency": "20 + (k * 13 + user_id * 7) % 480",
    "anomaly_score": "anomaly_score",
    "predicted_anomaly": "cast(anomaly_score < 0 as bigint)",
    "severity": SCORE_BANDS,
    "is_anomaly": f"cast({LABELLED} as bigint)",
    "anomaly_type": f"CASE WHEN {LABELLED} THEN {_pick_sql(['port_scan', 'command_injection', 'replay', 'data_exfiltration'], 'k % 4')} ELSE 'none' END",
    "label_octal": _pick_sql(["203", "206", "360"], "k % 3"),
    "ssm_bits": "lpad(bin(k % 4), 2, '0')",
    "data_bits": "lpad(bin((event_id * 31 + k * 977) % 524288), 19, '0')",
    "raw_hex": "concat('0x', lpad(hex((event_id * 2654435761 + k) % 4294967296), 8, '0'))",
    "top_features": "CASE k % 3 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('packet_size_zscore', 'port_anomaly_flag') ELSE array('frequency', 'cross_domain_flag') END",
    "explanation": "CASE WHEN k % 5 = 0 THEN '' ELSE concat('Unusual traffic on port ', k % 8, '. Review the sender.') END",
}


def evidence_of(raw: DataFrame) -> DataFrame:
    """The evidence view over event rows, batch or stream."""
    base = raw.selectExpr(
        "event_id", "ts", "user_id", "event_type", "cast(get_json_object(props, '$.k') as bigint) AS k",
        "cast(floor(value * 100D + 0.5D) as bigint) AS cents", f"cast(array_position({_names(EVENT_TYPES)}, event_type) - 1 as int) AS d",
    )
    placed = base.selectExpr(
        "event_id", "ts", "user_id", "event_type", "k", "cents", f"{_pick_sql(DOMAINS, 'd')} AS domain",
        f"{_pick_sql(DOMAINS, 'CASE WHEN k % 10 = 0 THEN (d + 1) % 5 ELSE d END')} AS dst_domain",
        "cast(6000 - cents as double) / 40000D AS anomaly_score",
    )
    return placed.selectExpr(*(f"{sql} AS {name}" for name, sql in EVIDENCE_COLUMNS.items()))


def payload(df: DataFrame) -> Column:
    """Canonical JSON of the event, the payload of its log entry."""
    names = ["anomaly_type", "data_format", "domain", "dst", "label_octal", "packet_size", "port", "protocol", "sequence", "src"]
    return crypto.canonical({name: F.col(name) for name in names})


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events with their details: the integrity rows of the evidence."""
    ev = evidence(spark, sf_dir).filter(F.col("domain") == "integrity")
    k = F.col("k")
    names = ["tamper_attempt_blocked", "tamper_attempt_no_effect", "recovery_ledger_restore", "integrity_check_failed"]
    attempt = k % 4 < 2
    return ev.select(
        "sequence",
        F.lit("security_event").alias("kind"),
        F.col("occurred_at").alias("created_at"),
        "occurred_us",
        "source_file",
        "source_offset",
        F.lit("SECURITY_EVENT").alias("source_type"),
        _by_index(k % 4, names).alias("event"),
        _by_index(k % 3, ["HIGH", "MEDIUM", "INFO"]).alias("severity"),
        F.when(attempt, _by_index(k % 2, ["update", "delete"])).alias("details_operation"),
        F.when(attempt, F.col("event_id") % 5000 + 1).alias("details_target_sequence"),
        F.when(attempt, F.col("event_id")).alias("attempt_id"),
        F.when(k % 3 == 0, F.lit("analyst")).otherwise(F.concat(F.lit("host [10.0.7."), k.cast("string"), F.lit("];"))).alias("details_actor"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked changes of protected tables, some already copied into the log."""
    ev = evidence(spark, sf_dir).filter((F.col("domain") == "integrity") & (F.col("k") < 8))
    k = F.col("k")
    return ev.select(
        F.col("event_id").alias("attempt_id"),
        F.col("occurred_at").alias("detected_at"),
        "occurred_us",
        _by_index(k % 2, ["UPDATE", "DELETE"]).alias("operation"),
        (F.col("event_id") % 5000 + 1).alias("target_sequence"),
        F.lit("blocked").alias("sqlite_action"),
        F.to_json(F.struct(
            F.when(k % 2 == 0, F.concat(F.lit("10.0.9."), k.cast("string"))).alias("attacker_ip"),
            F.when(k % 3 == 0, F.lit("log_entries")).alias("table"),
        )).alias("details_json"),
        F.when(k % 4 == 0, crypto.digest(F.col("event_id").cast("string"))).alias("chain_entry_hash"),
    )


def log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events ready to be sealed into a log."""
    ev = evidence(spark, sf_dir)
    return ev.select(
        F.col("sequence").alias("order_id"),
        F.col("occurred_at").alias("created_at"),
        "source_file",
        "source_type",
        "source_offset",
        F.to_json(F.struct(F.lit("csv_row").alias("ingest_mode"), F.col("source_offset").alias("row_index"))).alias("metadata_json"),
        payload(ev).cast("binary").alias("payload"),
    )


def sealed_log(spark: SparkSession, sf_dir: str, segment_rows: int = 64) -> integrity.Sealed:
    return integrity.seal(log_source(spark, sf_dir), ["order_id"], segment_rows=segment_rows, key_id="test-key")


def batches(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Checkpoint headers of the evidence: one per ``size`` neighbouring records."""
    ev = evidence(spark, sf_dir)
    return ev.groupBy(F.expr(f"(evidence_id - 1) div {size} + 1").alias("checkpoint_id")).agg(
        F.max("occurred_at").alias("created_at"), F.lit("evidence_batch").alias("checkpoint_type"),
        F.count(F.lit(1)).alias("batch_size"), F.min("evidence_id").alias("first_evidence_id"), F.max("evidence_id").alias("last_evidence_id"),
    )
