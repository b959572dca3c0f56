"""Aggregations. All use partial aggregation before their shuffle and keep bounded state
per group; nothing collects the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators.filters import flagged


def _baseline(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    out = []
    for name in columns:
        out.append(F.avg(name).alias(f"{name}_mean"))
        out.append(F.greatest(F.stddev_pop(name), F.lit(1.0)).alias(f"{name}_std"))
    return df.groupBy(key).agg(*out)


def domain_baseline(df: DataFrame, normal_only: bool = True) -> DataFrame:
    """Mean and population deviation (at least 1) of size and rate per domain."""
    rows = df.filter(F.col("is_anomaly") == 0) if normal_only else df
    return _baseline(rows, "domain", ["packet_size", "frequency"])


def label_baseline(df: DataFrame, normal_only: bool = False, key: str = "src") -> DataFrame:
    rows = df.filter(F.col("is_anomaly") == 0) if normal_only else df
    return _baseline(rows, key, ["data_bits_int"])


def ingest_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("domain", "data_format", "is_anomaly").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("frequency").alias("mean_frequency")
    )


def source_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("source_file", "source_type").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )


def evidence_totals(evidence: DataFrame, log: DataFrame) -> DataFrame:
    """Totals of evidence and log in one row; both sides are single-row aggregates."""
    ev = evidence.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("predicted_anomaly") == 1).alias("anomalies"),
        F.coalesce(F.min("anomaly_score"), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
    ).withColumn("_one", F.lit(1))
    lg = log.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.col("source_type") == "SECURITY_EVENT").alias("security_events_count"),
    ).withColumn("_one", F.lit(1))
    return ev.join(lg, "_one").drop("_one").withColumns(
        {"normal": F.col("total_records") - F.col("anomalies"), "total_alerts": F.col("anomalies") + F.col("security_events_count")}
    )


def severity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")).agg(F.count(F.lit(1)).alias("count"))


def severity_bucket_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(scalars.severity_bucket(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("count"))


def evaluate(scored: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts and rates of predicted against labelled anomalies."""
    truth, guess = F.col("is_anomaly") == 1, F.col("predicted_anomaly") == 1
    table = scored.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
        F.avg(F.when(~truth, F.col("anomaly_score"))).alias("mean_score_normal"),
        F.avg(F.when(truth, F.col("anomaly_score"))).alias("mean_score_anomaly"),
    )
    c = F.col

    def rate(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return table.withColumns(
        {
            "detection_rate": rate(c("tp"), c("tp") + c("fn")),
            "false_positive_rate": rate(c("fp"), c("fp") + c("tn")),
            "accuracy": rate(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
        }
    )


def composition(df: DataFrame, column: Column) -> DataFrame:
    key = F.coalesce(scalars.filled(column), F.lit("unknown"))
    return df.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("count"))


def severity_trend(df: DataFrame, time_us: str = "occurred_us", bucket_seconds: int = 60) -> DataFrame:
    """Flagged rows per bucket in three series, zero where a series has none."""
    width = bucket_seconds * 1_000_000
    rank = scalars.severity_rank(F.col("severity"))
    return flagged(df).groupBy((F.floor(F.col(time_us) / width) * width).cast("bigint").alias("bucket_us")).agg(
        F.count_if(rank >= 3).alias("high"), F.count_if(rank == 2).alias("medium"), F.count_if(rank < 2).alias("low")
    )


def top_counts(df: DataFrame, label: Column, n: int) -> DataFrame:
    counted = df.groupBy(F.coalesce(scalars.filled(label), F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "label").limit(n)


def top_sources(df: DataFrame, n: int = 8) -> DataFrame:
    return top_counts(flagged(df), scalars.source_label(df), n)


def volume_breakdown(df: DataFrame, n: int = 10) -> DataFrame:
    return top_counts(flagged(df), scalars.volume_label(df), n)


def family_breakdown(df: DataFrame, n: int = 8) -> DataFrame:
    return top_counts(flagged(df), scalars.family_label(df), n)


def top_reason_themes(df: DataFrame, n: int = 8) -> DataFrame:
    """Themes of all features of the flagged rows."""
    features = F.coalesce("top_features", F.array().cast("array<string>"))
    named = F.when(F.size(features) > 0, features).otherwise(F.array(F.lit("")))
    themes = flagged(df).select(F.explode(named).alias("feature")).select(scalars.reason_theme(F.col("feature")).alias("theme"))
    return top_counts(themes, F.col("theme"), n)


def severity_distribution(df: DataFrame) -> DataFrame:
    """Four classes; unflagged rows count as normal."""
    rank = scalars.severity_rank(F.col("severity"))
    is_flagged = F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1
    label = (
        F.when(~is_flagged, "Normal").when(rank == 3, "High").when(rank == 2, "Medium").when(rank == 1, "Low").otherwise("Normal")
    )
    return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))


def posture(df: DataFrame, bands=policy.POSTURE_BANDS) -> DataFrame:
    rank = scalars.severity_rank(F.col("severity"))
    hit = F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1
    totals = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("flagged"),
        F.count_if(hit & (rank == 3)).alias("high"), F.count_if(hit & (rank == 2)).alias("medium"),
        F.count_if(hit & (rank == 1)).alias("low"),
    )
    rate = F.when(F.col("total") > 0, F.col("flagged") / F.col("total")).otherwise(F.lit(0.0))
    label = None
    for bound, name in bands:
        label = F.when(F.col("alert_rate") >= bound, name) if label is None else label.when(F.col("alert_rate") >= bound, name)
    return totals.withColumn("alert_rate", rate).withColumns(
        {"posture": label.otherwise("Safe"), "normal": F.greatest(F.col("total") - F.col("flagged"), F.lit(0))}
    )


def group_alerts(df: DataFrame, order: str = "sequence", extra: list[Column] | None = None) -> DataFrame:
    """Flagged rows grouped by severity, score bucket, signature, domain and protocol.

    The first non-empty explanation and feature list in row order stand for the group.
    ``extra`` adds aggregates over the columns of ``df`` in the same pass.
    """
    def norm(column: Column) -> Column:
        return F.lower(F.trim(scalars.text_of(column)))

    def first(column: Column) -> Column:
        return F.coalesce(F.min_by(column, F.when(column.isNotNull(), F.col(order))), F.lit(""))

    score = F.coalesce("anomaly_score", F.lit(0.0))
    protocol = F.coalesce(scalars.filled(F.col("protocol")), scalars.filled(F.col("label_octal")))
    return flagged(df).groupBy(
        F.upper(F.coalesce(scalars.filled(F.col("severity")), F.lit("ANOMALY"))).alias("severity"),
        scalars.score_bucket_index(F.col("anomaly_score")).alias("score_bucket"),
        norm(scalars.anomaly_signature(df)).alias("signature"),
        norm(F.col("domain")).alias("domain"),
        norm(protocol).alias("protocol"),
    ).agg(
        F.count(F.lit(1)).alias("events"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        first(scalars.filled(F.col("explanation"))).alias("explanation"),
        first(F.when(F.size("top_features") > 0, F.array_join("top_features", " / "))).alias("top_features"),
        *(extra or []),
    )


def order_alerts(groups: DataFrame) -> DataFrame:
    keys = ["signature", "domain", "protocol", "score_bucket"]
    return groups.orderBy(F.desc(scalars.severity_rank(F.col("severity"))), "min_score", F.desc("events"), *keys)


def activity_batches(feed: DataFrame) -> DataFrame:
    """Activity grouped by batch: worst class, latest time, number of members. The
    members themselves are read with ``batch_members`` so that no group is collected."""
    return feed.groupBy("batch_key").agg(
        F.count(F.lit(1)).alias("items"),
        F.max("recorded_at").alias("latest_at"),
        F.when(F.bool_or(F.col("classification") == "Critical"), "Critical").otherwise("Normal").alias("classification"),
        F.min_by("kind_label", F.struct("recorded_at", "record_id")).alias("kind_label"),
    )


def batch_members(feed: DataFrame, batch_key: str) -> DataFrame:
    return feed.filter(F.col("batch_key") == batch_key).orderBy(F.desc("recorded_at"), "record_id")


def intake_totals(sources: DataFrame) -> DataFrame:
    """Records and capture chunks written, from the source summary."""
    is_capture = scalars.source_kind(F.col("source_type"), F.col("source_file")) == "PCAP"
    return sources.agg(
        F.coalesce(F.sum(F.when(~is_capture, F.col("records"))), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.when(is_capture, F.col("records"))), F.lit(0)).alias("capture_chunks"),
    )


def graph_stats(events: DataFrame) -> DataFrame:
    """Counts of the filtered events by four attributes, in long form."""
    kinds = ["domain", "severity", "pattern", "event_type"]
    pairs = F.array(*(F.struct(F.lit(k).alias("attribute"), F.col(k).cast("string").alias("value")) for k in kinds))
    return events.select(F.explode(pairs).alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("events"))


def mean_risk(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.coalesce(scalars.round_half_up(F.avg("risk"), 4), F.lit(0.0)).alias("avg_risk"))


def risk_stats(events: DataFrame) -> DataFrame:
    r = F.col("risk")
    return events.agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(r > 0.8).alias("critical_anomalies"),
        F.count_if((r > 0.6) & (r <= 0.8)).alias("high_risk_anomalies"),
        F.coalesce(F.max(r), F.lit(0.0)).alias("max_risk"), F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_risk"),
    )


def domain_cards(df: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("events"), F.count_if(hit).alias("flagged")).withColumn(
        "state", F.when(F.col("flagged") > 0, "incident").otherwise("clean")
    )


def readiness_report(entries: DataFrame, trusted: bool, recovery_ok: bool) -> DataFrame:
    """Reporting readiness: evidence, explanations and trust in one row."""
    reasons = (
        scalars.filled(F.col("explanation")).isNotNull()
        | scalars.filled(scalars.pick(entries, "summary")).isNotNull()
        | (F.size("top_features") > 0)
    )
    counted = entries.agg(F.count(F.lit(1)).alias("evidence_items"), F.count_if(reasons).alias("explained_items"))
    ready = F.lit(trusted) & (F.col("evidence_items") > 0) & (F.col("explained_items") > 0)
    rows = counted.withColumns({"chain_ready": F.lit(trusted), "recovery_ready": F.lit(recovery_ok), "report_ready": ready})
    return rows.withColumn("ready_count", sum(F.col(c).cast("int") for c in ("chain_ready", "recovery_ready")) + 2 * F.col("report_ready").cast("int"))


def sources(log: DataFrame) -> DataFrame:
    return log.select("source_file").distinct()


def log_span(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_entries"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
