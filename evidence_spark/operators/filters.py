"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import scalars


def flagged(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1)


def filter_events(
    df: DataFrame, severity_threshold: float = 0.5, severity_levels: list[str] | None = None,
    domains: list[str] | None = None, event_types: list[str] | None = None,
    time_window_ms: int | None = None, now: Column | None = None,
) -> DataFrame:
    """Filter normalised events. Named severities replace the risk threshold; the time
    window counts back from ``now``, and a time that cannot be read counts as now."""
    if time_window_ms:
        at = scalars.parse_time(F.col("timestamp"), now)
        df = df.filter(F.unix_micros(at) >= F.unix_micros(now) - time_window_ms * 1000)
    if severity_levels:
        df = df.filter(F.upper("severity").isin([s.upper() for s in severity_levels if s]))
    else:
        df = df.filter(F.col("risk") >= severity_threshold)
    if domains:
        df = df.filter(F.lower(F.coalesce("domain", F.lit("unknown"))).isin([d.lower() for d in domains if d]))
    if event_types:
        df = df.filter(F.lower("event_type").isin([e.lower() for e in event_types if e]))
    return df


def filter_severity(df: DataFrame, severity: str) -> DataFrame:
    return df if severity == "all" else df.filter(scalars.severity_bucket(F.col("severity")) == severity)


def search(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Rows whose listed columns, joined by blanks, contain the text (any case)."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    joined = F.concat_ws(" ", *(scalars.filled(F.col(c).cast("string")) for c in cols))
    return df.filter(F.lower(joined).contains(wanted))


def filter_replay(df: DataFrame, domain: str | None = None, anomalies_only: bool = False) -> DataFrame:
    if domain:
        df = df.filter(F.col("domain") == domain)
    return flagged(df) if anomalies_only else df


def security_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_type") == "SECURITY_EVENT")


def entry(df: DataFrame, sequence: int) -> DataFrame:
    return df.filter(F.col("sequence") == sequence)


def page(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered view; None keeps all."""
    return df if n is None else df.limit(n)


def unsynced_attempts(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Attempts without a chain hash, oldest first."""
    return page(df.filter(F.col("chain_entry_hash").isNull()).orderBy("attempt_id"), limit)


def last_window(df: DataFrame, time_us: str, end_us: int, span_ms: int) -> DataFrame:
    return df.filter(F.col(time_us).between(end_us - span_ms * 1000, end_us))
