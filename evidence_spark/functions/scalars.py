"""Column functions: every rule is a Catalyst expression, so it stays inside codegen."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
STRICT_IPV4 = rf"^(?:{OCTET}\.){{3}}{OCTET}$"


# --- small building blocks -----------------------------------------------------------

def has(df: DataFrame, name: str) -> bool:
    """Whether the table has a column. The names are read from the JVM once per table."""
    names = df.__dict__.get("_known_columns")
    if names is None:
        names = df.__dict__["_known_columns"] = frozenset(df.columns)
    return name in names


def pick(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The named column, or a typed null when the table does not have it."""
    return F.col(name).cast(kind) if has(df, name) else F.lit(None).cast(kind)


def filled(column: Column) -> Column:
    """Null for empty text, so that ``coalesce`` skips it like any other missing value."""
    return F.when(column.cast("string") != "", column)


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def round_half_up(column: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(column * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def contains_any(column: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | column.contains(word)
    return hit


def title_case(column: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(column), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), w.substr(F.lit(2), F.length(w)))),
        "",
    )


def base_name(column: Column) -> Column:
    return F.regexp_extract(text_of(column), r"([^\\/]*)$", 1)


def lookup(column: Column, table: dict, default) -> Column:
    chain = None
    for key, value in table.items():
        condition = column == F.lit(key)
        chain = F.when(condition, F.lit(value)) if chain is None else chain.when(condition, F.lit(value))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


# --- bit fields and sizes ---------------------------------------------------------------

def bits_to_bytes(column: Column) -> Column:
    """Length of a bit-string field in whole bytes; 0 when there is none."""
    return F.coalesce(F.ceil(F.length(column) / F.lit(8)), F.lit(0)).cast("bigint")


def bits_to_int(column: Column) -> Column:
    return F.conv(column, 2, 10).cast("bigint")


def parity_valid(column: Column) -> Column:
    """1 when the low 32 bits of a hex word hold an odd number of ones."""
    digits = F.regexp_replace(column, "^0[xX]", "")
    word = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("bigint")
    return (F.bit_count(word) % 2).cast("int")


# --- addresses and policy flags -----------------------------------------------------------

def ipv4_number(column: Column) -> Column:
    """Dotted text as a number; null for anything that is not a plain IPv4 address."""
    number = F.aggregate(F.split(column, r"\."), F.lit(0).cast("bigint"), lambda acc, part: acc * 256 + part.cast("bigint"))
    return F.when(column.rlike(STRICT_IPV4), number)


def network_of(number: Column, networks: dict[str, str] = policy.DOMAIN_NETWORKS) -> Column:
    """Name of the first network that holds an address given as a number."""
    chain = F.lit(None).cast("string")
    for name, cidr in reversed(list(networks.items())):
        net = ipaddress.ip_network(cidr)
        low, high = int(net.network_address), int(net.broadcast_address)
        chain = F.when(number.between(low, high), F.lit(name)).otherwise(chain)
    return chain


def ip_domain(column: Column, networks: dict[str, str] = policy.DOMAIN_NETWORKS) -> Column:
    return network_of(ipv4_number(column), networks)


def cross_domain_flag(src: Column, dst: Column, networks: dict[str, str] = policy.DOMAIN_NETWORKS) -> Column:
    return F.coalesce((ip_domain(src, networks) != ip_domain(dst, networks)).cast("int"), F.lit(0))


def port_expected(domain: Column, port: Column, ports=policy.EXPECTED_PORTS, ranges=policy.EXPECTED_PORT_RANGES) -> Column:
    ok = F.lit(False)
    for name, allowed in ports.items():
        rule = port.isin(allowed)
        for low, high in ranges.get(name, []):
            rule = rule | port.between(low, high)
        ok = ok | ((domain == name) & rule)
    return F.coalesce(ok, F.lit(False))


def port_flag(domain: Column, port: Column, **rules) -> Column:
    """1 for a port outside the expectation; an expected port is never flagged,
    even when it is on the sensitive list, so the list itself adds no further rows."""
    return F.when(port_expected(domain, port, **rules), 0).otherwise(1)


def sensitive_port(port: Column, ports=policy.SENSITIVE_PORTS) -> Column:
    return port.isin(ports)


def protocol_flag(domain: Column, protocol: Column, expected=policy.EXPECTED_PROTOCOLS) -> Column:
    ok = F.lit(False)
    for name, allowed in expected.items():
        ok = ok | ((domain == name) & protocol.isin(allowed))
    return F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)


def security_flags(df: DataFrame) -> DataFrame:
    """Add the three policy flags: computed for packet rows, zero for all others."""
    packet = F.col("data_format") == policy.PACKET_FORMAT
    # addresses are parsed once per row; the zone tests then compare numbers
    parsed = df.withColumns(
        {"_src": F.when(packet, ipv4_number(F.col("src"))), "_dst": F.when(packet, ipv4_number(F.col("dst")))}
    )
    crossed = F.coalesce((network_of(F.col("_src")) != network_of(F.col("_dst"))).cast("bigint"), F.lit(0))
    return parsed.withColumns(
        {
            "cross_domain_flag": crossed.cast("bigint"),
            "port_anomaly_flag": F.when(packet, port_flag(F.col("domain"), F.col("port"))).otherwise(0).cast("bigint"),
            "protocol_anomaly_flag": F.when(packet, protocol_flag(F.col("domain"), F.col("protocol"))).otherwise(0).cast("bigint"),
        }
    ).drop("_src", "_dst")


# --- severity and risk ----------------------------------------------------------------------

def severity_band(score: Column, cutoffs=policy.SEVERITY_CUTOFFS) -> Column:
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for cutoff, label in cutoffs:
        chain = chain.when(score < F.lit(float(cutoff)), F.lit(label))
    return chain.otherwise(F.lit("NONE"))


def canonical_severity(column: Column) -> Column:
    return lookup(F.upper(F.coalesce(filled(column), F.lit("NORMAL"))), policy.CANONICAL_SEVERITY, "NORMAL")


def severity_bucket(column: Column) -> Column:
    text = F.lower(F.coalesce(filled(column), F.lit("normal")))
    return (
        F.when(text.contains("critical") | text.contains("high"), "high")
        .when(text.contains("warning") | text.contains("medium"), "medium")
        .when(text.contains("low"), "low")
        .otherwise("normal")
    )


def severity_rank(column: Column) -> Column:
    return lookup(F.upper(text_of(column)), policy.SEVERITY_RANK, 0).cast("int")


def risk_score(score: Column, severity: Column) -> Column:
    """Larger of the severity weight and a piecewise function of the model score.

    A missing score counts as zero, which lifts the risk to at least 0.55.
    """
    s = F.coalesce(score.cast("double"), F.lit(0.0))
    weight = lookup(F.upper(F.coalesce(filled(severity), F.lit("ANOMALY"))), policy.SEVERITY_RISK, 0.6)
    by_score = (
        F.when(s < 0, F.least(F.lit(1.0), F.lit(0.55) + F.abs(s) * F.lit(2.0)))
        .when(s <= F.lit(0.05), F.greatest(F.lit(0.25), F.lit(0.55) - s * F.lit(4.0)))
        .when(s <= 1, s)
        .otherwise(F.lit(0.25))
    )
    return round_half_up(F.greatest(weight, by_score), 4)


def score_bucket(column: Column, step: float = policy.SCORE_BUCKET_STEP) -> Column:
    return F.floor(F.coalesce(column, F.lit(0.0)) / F.lit(step) + F.lit(0.5)) * F.lit(step)


def score_bucket_index(column: Column, step: float = policy.SCORE_BUCKET_STEP) -> Column:
    return F.floor(F.coalesce(column, F.lit(0.0)) / F.lit(step) + F.lit(0.5)).cast("bigint")


# --- names, labels and ids --------------------------------------------------------------------

def slug(kind: str, column: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(filled(column), F.lit("unknown"))))
    safe = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(f"{kind}-"), F.coalesce(filled(safe), F.lit("unknown")))


def short_label(column: Column, limit: int = 24) -> Column:
    text = F.coalesce(filled(column), F.lit("Unknown"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit(".")))


def event_label(event_type: Column, sequence: Column, severity: Column) -> Column:
    prefix = lookup(event_type, {"mutation_attempt": "DB Mutation Attempt", "chain_integrity": "Chain Integrity"}, "AI Alert")
    return F.concat(prefix, F.lit(" #"), sequence.cast("string"), F.lit(" ["), title_case(severity), F.lit("]"))


def flow_label(service: Column, protocol: Column, port: Column) -> Column:
    name = F.upper(F.coalesce(filled(service), filled(protocol), F.lit("traffic")))
    shown = filled(port.cast("string"))
    return F.when(shown.isNull() | (shown == "0"), name).otherwise(F.concat(name, F.lit(":"), shown))


def first_sentence(column: Column, limit: int = 64) -> Column:
    return F.substring(F.substring_index(column, ".", 1), 1, limit)


def ip_from_text(column: Column) -> Column:
    """First whitespace-separated token that is an IPv4 address once brackets and
    punctuation at its ends are removed."""
    tokens = F.transform(F.split(text_of(column), r"\s+"), lambda t: F.regexp_replace(t, r"^[\[\](),;:]+|[\[\](),;:]+$", ""))
    good = F.filter(tokens, lambda t: t.rlike(rf"^(?:0*{OCTET}\.){{3}}0*{OCTET}$"))
    return F.get(good, F.lit(0))


# --- time ------------------------------------------------------------------------------------------

def parse_time(column: Column, fallback: Column | None = None) -> Column:
    """ISO text to a UTC timestamp. ``Z`` means UTC, text without a zone is UTC, and
    text that cannot be read becomes ``fallback`` (null when none is given)."""
    text = F.trim(column.cast("string"))
    zoned = text.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    parsed = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
    return F.coalesce(parsed, fallback) if fallback is not None else parsed


def epoch_millis(column: Column) -> Column:
    """Numeric text is seconds below 1e12 and milliseconds above; other text is ISO."""
    number = column.cast("string").try_cast("double")
    as_ms = F.when(number < F.lit(1e12), number * F.lit(1000.0)).otherwise(number)
    return F.coalesce(as_ms, F.unix_micros(parse_time(column)) / F.lit(1000.0))


def event_time(df: DataFrame) -> Column:
    return F.coalesce(*(filled(pick(df, name)) for name in ("occurred_at", "recorded_at", "created_at")))


def audit_time(df: DataFrame) -> Column:
    names = ("recorded_at", "created_at", "detected_at", "occurred_at", "timestamp")
    return F.coalesce(*(filled(pick(df, name)) for name in names))


def event_sequence(df: DataFrame, fallback: Column | None = None) -> Column:
    names = ("sequence", "target_sequence", "evidence_id")
    options = [F.nullif(pick(df, name, "bigint"), F.lit(0)) for name in names]
    return F.coalesce(*options, *( [fallback] if fallback is not None else [] ))


# --- log and source labels ---------------------------------------------------------------------------

def offset_unit(ingest_mode: Column, source_type: Column) -> Column:
    return (
        F.when(ingest_mode == "csv_row", "Row")
        .when(ingest_mode == "binary_chunk", "Chunk")
        .when(source_type == "SECURITY_EVENT", "Event")
        .otherwise("Offset")
    )


def source_kind(source_type: Column, source_file: Column) -> Column:
    kind, file = F.upper(text_of(source_type)), F.lower(text_of(source_file))
    return (
        F.when((kind == "PCAP") | file.endswith(".pcap"), "PCAP")
        .when(file.endswith("_labels.csv"), "CSV Labels")
        .when((kind == "CSV") | file.endswith(".csv"), "CSV")
        .when(kind == "DEMO_MANIFEST", "Manifest")
        .when(kind == "SECURITY_EVENT", "Security")
        .otherwise(F.coalesce(filled(kind), F.lit("Source")))
    )


def source_rank(kind: Column) -> Column:
    return lookup(kind, {"PCAP": 0, "CSV": 1, "CSV Labels": 2}, 3).cast("int")


def source_label(df: DataFrame) -> Column:
    stem = F.regexp_replace(base_name(pick(df, "source_file")), r"(?i)(_traffic|_scores)?\.csv$", "")
    from_file = F.coalesce(filled(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit("Unknown source"))
    return F.coalesce(F.replace(filled(pick(df, "domain")), F.lit("_"), F.lit(" ")), from_file)


def scenario_label(path: Column, run_folder: str) -> Column:
    """Folder or ``standalone_`` part of a path that names the scenario."""
    text = text_of(path)
    by_folder = F.regexp_extract(text, rf"(?i){run_folder}[\\/]+([^\\/]+)", 1)
    standalone = F.regexp_extract(text, r"(?i)standalone_([^\\/]+)", 1)
    return F.replace(F.coalesce(filled(by_folder), filled(standalone)), F.lit("_"), F.lit(" "))


def volume_label(df: DataFrame) -> Column:
    return F.coalesce(
        F.upper(filled(pick(df, "protocol"))),
        F.concat(F.lit("ARINC "), filled(pick(df, "label_octal"))),
        F.replace(filled(pick(df, "domain")), F.lit("_"), F.lit(" ")),
        filled(pick(df, "data_format")),
        source_label(df),
    )


def family_label(df: DataFrame, run_folder: str = r"[^\\/]*demo") -> Column:
    kind = F.trim(text_of(pick(df, "anomaly_type")))
    named = F.when((kind != "") & (F.lower(kind) != "none"), F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.coalesce(named, filled(scenario_label(pick(df, "source_file"), run_folder)), source_label(df))


def reason_theme(feature: Column, themes=policy.REASON_THEMES) -> Column:
    text = F.lower(text_of(feature))
    chain = F.when(text == "", F.lit("Model threshold"))
    for pattern, label in themes:
        chain = chain.when(text.rlike(pattern), F.lit(label))
    return chain.otherwise(F.replace(feature, F.lit("_"), F.lit(" ")))


def protocol_label(df: DataFrame) -> Column:
    service = F.coalesce(*(filled(pick(df, n)) for n in ("service", "protocol", "source_type", "event_type")), F.lit("event"))
    probe = F.lower(F.concat_ws(" ", *(filled(pick(df, n)) for n in ("data_format", "protocol", "service", "source_component", "target_component")), service))
    words = F.concat_ws(" ", *(filled(pick(df, n)) for n in ("label_octal", "service", "protocol", "source_component", "target_component", "summary", "explanation")))
    on_bus = probe.contains("arinc") | probe.contains("avionics word") | probe.contains("label ")
    label = F.coalesce(filled(F.regexp_extract(words, r"\b(206|360)\b", 1)), F.lit("206"))
    return F.when(on_bus, F.concat(F.lit("ARINC "), label)).otherwise(F.upper(F.trim(F.replace(service, F.lit("_"), F.lit(" ")))))


def component_label(column: Column) -> Column:
    text = F.trim(text_of(column))
    number = F.regexp_extract(text, r"(?i)\blabel\s+(\d+)\b", 1)
    return (
        F.when(number != "", F.when(number == "360", "ARINC 360").otherwise("ARINC 206"))
        .when(F.lower(text).contains("arinc 429 bus"), "ARINC Bus")
        .otherwise(F.coalesce(filled(text), F.lit("Unknown")))
    )


def anomaly_signature(df: DataFrame) -> Column:
    """What an alert is about: type, else features, else first sentence, else fields."""
    kind = F.lower(F.trim(text_of(pick(df, "anomaly_type"))))
    features = (
        F.array_join(F.filter(F.col("top_features"), lambda f: f.isNotNull() & (f != "")), " / ")
        if has(df, "top_features")
        else F.lit(None).cast("string")
    )
    said = F.lower(F.trim(text_of(pick(df, "explanation"))))
    port = filled(pick(df, "port"))
    fields = F.concat_ws(
        " / ",
        filled(pick(df, "data_format")),
        filled(pick(df, "domain")),
        F.coalesce(filled(pick(df, "protocol")), filled(pick(df, "label_octal"))),
        F.when(port != "0", F.concat(F.lit("port "), port)),
    )
    return F.coalesce(
        F.when((kind != "") & (kind != "none"), F.replace(kind, F.lit("_"), F.lit(" "))),
        F.replace(filled(features), F.lit("_"), F.lit(" ")),
        filled(F.substring_index(said, ".", 1)),
        filled(fields),
        F.lit("model threshold"),
    )


def is_critical(event_name: Column, severity: Column, operation: Column | None = None) -> Column:
    words = F.concat_ws(" ", F.lower(text_of(event_name)), F.lower(text_of(operation if operation is not None else F.lit(""))))
    return F.upper(text_of(severity)).isin("CRITICAL", "HIGH") | contains_any(words, policy.CRITICAL_WORDS)


def _audit_text(df: DataFrame) -> Column:
    names = ("kind", "kind_label", "activity", "event", "source_type", "context", "operation", "details_operation")
    return F.lower(F.concat_ws(" ", *(filled(pick(df, n)) for n in names)))


def audit_title(df: DataFrame) -> Column:
    operation = F.coalesce(filled(pick(df, "operation")), filled(pick(df, "details_operation")))
    return F.coalesce(
        filled(pick(df, "activity")),
        title_case(F.replace(filled(pick(df, "event")), F.lit("_"), F.lit(" "))),
        F.concat(title_case(operation), F.lit(" attempt")),
        F.lit("Audit event"),
    )


def audit_status(df: DataFrame) -> Column:
    text = _audit_text(df)
    synced = F.coalesce(pick(df, "synced_to_chain", "boolean"), F.lit(False))
    fallback = F.coalesce(filled(pick(df, "classification")), filled(pick(df, "severity")), F.lit("Recorded"))
    return (
        F.when(synced | text.contains("blocked"), "Blocked")
        .when(text.contains("restore") | text.contains("recovery"), "Recovery")
        .when(text.contains("corrupt") | text.contains("tamper"), "Detected")
        .when(text.contains("successful"), "Successful")
        .otherwise(title_case(fallback))
    )


def canonical_source(column: Column, root: str) -> Column:
    """One canonical key per source: URLs as they are, paths absolute under ``root``
    with ``.`` and doubled separators removed, in lower case."""
    text = text_of(column)
    absolute = F.when(text.startswith("/"), text).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), text))
    parts = F.filter(F.split(absolute, "/+"), lambda p: (p != "") & (p != "."))
    # ".." takes back the part before it; the fold keeps the open parts as it goes
    folded = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.when(text.contains("://"), text).otherwise(F.lower(F.concat(F.lit("/"), F.array_join(folded, "/"))))
