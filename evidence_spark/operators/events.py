"""Normalisation of mixed evidence records into graph events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.functions.scalars import filled, pick

ANOMALY, INTEGRITY, MUTATION = "anomaly", "chain_integrity", "mutation_attempt"


def any_of(df: DataFrame, *names: str) -> Column:
    """First named column that holds text."""
    return F.coalesce(*(filled(pick(df, n)) for n in names), F.lit(None).cast("string"))


def nonzero(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*(F.when(~pick(df, n).isin("", "0"), pick(df, n)) for n in names))


def event_type(df: DataFrame) -> Column:
    declared = F.lower(F.coalesce(any_of(df, "event_type", "type"), F.lit(ANOMALY)))
    name = F.lower(scalars.text_of(pick(df, "event")))
    has_details = any_of(
        df, "details_operation", "details_target_sequence", "details_actor", "details_attacker_ip", "details_records_restored"
    ).isNotNull()
    mutation = (
        (scalars.text_of(pick(df, "kind")) == MUTATION)
        | (declared == MUTATION)
        | name.isin(policy.BLOCKED_EVENT_NAMES)
        | (any_of(df, "details_operation").isNotNull() & nonzero(df, "details_target_sequence").isNotNull())
    )
    return F.when(mutation, MUTATION).when((name != "") | has_details | (declared == "security_event"), INTEGRITY).otherwise(declared)


def infer_domain(df: DataFrame, kind: Column) -> Column:
    chain = F.when(kind.isin(INTEGRITY, MUTATION), "integrity")
    explicit = F.lower(F.trim(scalars.text_of(pick(df, "domain"))))
    chain = chain.when(explicit != "", explicit)
    on_bus = (F.upper(scalars.text_of(pick(df, "data_format"))) == policy.WORD_FORMAT) | any_of(df, "label_octal").isNotNull()
    chain = chain.when(on_bus, policy.WORD_DOMAIN)
    for name in ("src", "src_ip", "source_ip", "dst", "dst_ip", "destination_ip"):
        address = F.lower(F.trim(scalars.text_of(pick(df, name))))
        for prefix, domain in policy.ADDRESS_PREFIX_DOMAINS:
            chain = chain.when(address.startswith(prefix), domain)
    probe = F.lower(F.concat_ws(
        " ", scalars.base_name(pick(df, "source_file")),
        any_of(df, "explanation", "summary", "description"), any_of(df, "service", "protocol"),
    ))
    for word in ("avionics", "maintenance", "cabin", "afdx"):
        chain = chain.when(probe.contains(word), word)
    return chain.otherwise("unknown")


def resolve_endpoints(df: DataFrame, kind: Column) -> tuple[Column, Column]:
    actor = any_of(df, "details_actor", "actor")
    attacker = F.coalesce(
        any_of(df, "source_component", "attacker_ip", "details_attacker_ip", "details_actor_ip"),
        scalars.ip_from_text(actor), F.lit(policy.DEFAULT_ATTACKER_ADDRESS),
    )
    plain = F.coalesce(
        any_of(df, "source_component", "src", "src_ip", "source_ip"),
        filled(scalars.base_name(pick(df, "source_file"))), F.lit("Unknown Source"),
    )
    source = F.when(kind == MUTATION, attacker).when(kind == INTEGRITY, F.coalesce(actor, F.lit("Trust Monitor"))).otherwise(plain)

    attempted = F.concat(F.lit("SEQ #"), nonzero(df, "target_sequence", "details_target_sequence", "sequence"))
    chained = F.concat(F.lit("Evidence Chain #"), nonzero(df, "details_target_sequence", "details_records_restored", "sequence"))
    port = nonzero(df, "port", "dst_port", "destination_port")
    named = any_of(df, "target_component", "dst", "dst_ip", "destination_ip")
    fallback = F.concat(F.coalesce(any_of(df, "protocol", "service"), F.lit("Observed")), F.lit(" target"))
    target = (
        F.when(kind == MUTATION, F.coalesce(attempted, F.lit("Evidence Chain")))
        .when(kind == INTEGRITY, F.coalesce(chained, F.lit("Evidence Chain")))
        .otherwise(F.coalesce(F.concat(named, F.lit(":"), port), named, fallback))
    )
    return source, target


def attack_pattern(df: DataFrame, kind: Column) -> Column:
    words = lambda c: scalars.title_case(F.replace(c, F.lit("_"), F.lit(" ")))
    operation = F.coalesce(any_of(df, "operation", "details_operation"), F.lit("mutation"))
    blocked = F.lower(F.coalesce(any_of(df, "event", "activity"), F.lit(""))).contains("blocked")
    attempt = F.concat(F.lit("DB "), scalars.title_case(operation), F.lit(" Attempt "), F.when(blocked, "Blocked").otherwise("Recorded"))
    features = (
        F.when(F.size("top_features") > 0, F.array_join(F.transform(F.slice("top_features", 1, 2), lambda f: words(f)), " / "))
        if scalars.has(df, "top_features") else F.lit(None).cast("string")
    )
    return (
        F.when(kind == MUTATION, attempt)
        .when(kind == INTEGRITY, words(F.coalesce(any_of(df, "event"), F.lit("Integrity Recovery"))))
        .otherwise(F.coalesce(
            words(any_of(df, "anomaly_type", "attack_type")), features,
            scalars.first_sentence(any_of(df, "explanation", "summary")), F.lit("AI Anomaly"),
        ))
    )


def normalize_events(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Graph events from evidence, security events and change attempts."""
    kind = event_type(df)
    typed = df.withColumn("_kind", kind)
    kind = F.col("_kind")
    sequence = F.coalesce(scalars.event_sequence(df), pick(df, "index", "bigint"))
    raw_severity = F.upper(F.coalesce(any_of(df, "severity"), F.when(kind == INTEGRITY, "CRITICAL").otherwise("ANOMALY")))
    severity = scalars.canonical_severity(raw_severity)
    source, target = resolve_endpoints(df, kind)
    pattern = attack_pattern(df, kind)
    timestamp = scalars.event_time(df)
    said = any_of(df, "summary", "explanation", "description", "event")
    at = pick(df, "occurred_us", "bigint")
    parsed = F.unix_micros(scalars.parse_time(timestamp, now))
    port = F.coalesce(*(filled(pick(df, n)) for n in ("port", "dst_port", "destination_port")))
    features = F.col("top_features") if scalars.has(df, "top_features") else F.lit(None).cast("array<string>")
    return typed.select(
        F.concat_ws("-", kind, sequence.cast("string")).alias("event_id"),
        sequence.alias("sequence"),
        kind.alias("event_type"),
        infer_domain(df, kind).alias("domain"),
        severity.alias("severity"),
        scalars.risk_score(pick(df, "anomaly_score", "double"), raw_severity).alias("risk"),
        pick(df, "anomaly_score", "double").alias("anomaly_score"),
        source.alias("source_component"),
        target.alias("target_component"),
        pattern.alias("pattern"),
        timestamp.alias("timestamp"),
        F.coalesce(at, parsed).alias("event_us"),
        scalars.event_label(kind, sequence, severity).alias("label"),
        F.coalesce(said, pattern).alias("description"),
        scalars.flow_label(pick(df, "service"), pick(df, "protocol"), port).alias("flow"),
        F.coalesce(any_of(df, "service", "protocol"), F.lit("observed")).alias("observed"),
        F.coalesce(features, F.array().cast("array<string>")).alias("top_features"),
    )
