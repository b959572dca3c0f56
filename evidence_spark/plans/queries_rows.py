"""Row-level rules, filters and joins over the evidence view."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import crypto, scalars, text
from evidence_spark.operators import aggregates, events, feeds, filters, joins
from evidence_spark.plans import oracle as o
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.registry import query

BUCKET = "floor(anomaly_score / CAST(0.005 AS DOUBLE) + CAST(0.5 AS DOUBLE))"
SIGNATURE = """CASE WHEN anomaly_type <> 'none' THEN replace(lower(anomaly_type), '_', ' ')
  WHEN len(top_features) > 0 THEN replace(array_to_string(top_features, ' / '), '_', ' ')
  WHEN explanation <> '' THEN split_part(lower(explanation), '.', 1)
  ELSE data_format || ' / ' || domain || ' / ' || protocol || CASE WHEN port <> 0 THEN ' / port ' || port ELSE '' END END"""

ZSTATS = f"""
flagged_ev AS (SELECT *, {o.flags()} FROM ev),
stats AS (SELECT domain, avg(packet_size) AS pm, greatest(stddev_pop(packet_size), 1) AS ps,
                 avg(frequency) AS fm, greatest(stddev_pop(frequency), 1) AS fs
          FROM flagged_ev WHERE is_anomaly = 0 GROUP BY domain)
"""


@query("flagship_alert_groups", with_ev(
    f"""SELECT severity, CAST({BUCKET} AS BIGINT) AS score_bucket, lower(trim({SIGNATURE})) AS signature, domain, lower(protocol) AS protocol,
    count(*) AS events, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score,
    coalesce(arg_min(nullif(explanation, ''), sequence) FILTER (explanation <> ''), '') AS explanation,
    coalesce(arg_min(array_to_string(top_features, ' / '), sequence) FILTER (len(top_features) > 0), '') AS top_features,
    round(max(greatest((packet_size - coalesce(pm, 0)) / coalesce(ps, 1), 0)), 4) AS max_size_zscore,
    CAST(sum(cross_domain_flag + port_anomaly_flag + protocol_anomaly_flag) AS BIGINT) AS policy_flags,
    max({o.risk('anomaly_score', 'severity')}) AS max_risk
    FROM flagged_ev LEFT JOIN stats USING (domain) WHERE predicted_anomaly = 1
    GROUP BY 1, 2, 3, 4, 5""", ZSTATS))
def flagship_alert_groups(spark, sf):
    """Policy flags, baseline deviation, risk and alert groups in one pass plan."""
    ev = scalars.security_flags(proxy.evidence(spark, sf))
    stats = aggregates.domain_baseline(ev)
    scored = joins.apply_zscores(ev, stats, "domain", ["packet_size", "frequency"])
    flags = F.col("cross_domain_flag") + F.col("port_anomaly_flag") + F.col("protocol_anomaly_flag")
    return aggregates.order_alerts(aggregates.group_alerts(scored, extra=[
        F.round(F.max("packet_size_zscore"), 4).alias("max_size_zscore"),
        F.sum(flags).alias("policy_flags"),
        F.max(scalars.risk_score(F.col("anomaly_score"), F.col("severity"))).alias("max_risk"),
    ]))


@query("conform_unified", with_ev(
    f"""SELECT CAST(occurred_us AS DOUBLE) / 1000000 AS timestamp, domain, data_format,
      CASE WHEN data_format = 'ARINC429' THEN label_octal ELSE src END AS src,
      CASE WHEN data_format = 'ARINC429' THEN 'BUS_A' ELSE dst END AS dst,
      CASE WHEN data_format = 'ARINC429' THEN CAST(ceil(length(data_bits) / 8.0) AS BIGINT) ELSE packet_size END AS packet_size,
      frequency, CASE WHEN data_format = 'ARINC429' THEN 'ARINC429' ELSE protocol END AS protocol,
      CASE WHEN data_format = 'ARINC429' THEN 0 ELSE port END AS port, is_anomaly,
      {o.flags()} FROM ev WHERE data_format IN ('PCAP', 'ARINC429')"""))
def conform_unified(spark, sf):
    from evidence_spark.plans.detection import conform, words_to_unified

    ev = proxy.evidence(spark, sf).withColumn("timestamp", F.col("occurred_us") / F.lit(1e6))
    packets = ev.filter(F.col("data_format") == "PCAP")
    words = words_to_unified(ev.filter(F.col("data_format") == "ARINC429")).withColumn("frequency", F.col("frequency"))
    return conform(feeds.unify(packets.select(*words.columns), words))


@query("security_flags", with_ev(f"SELECT event_id, domain, src, dst, port, protocol, {o.flags()} FROM ev"))
def security_flags(spark, sf):
    ev = scalars.security_flags(proxy.evidence(spark, sf))
    return ev.select("event_id", "domain", "src", "dst", "port", "protocol", "cross_domain_flag", "port_anomaly_flag", "protocol_anomaly_flag")


@query("word_parity_bits", with_ev("""SELECT event_id, raw_hex, CAST(bit_count(CAST(raw_hex AS BIGINT)) % 2 AS INTEGER) AS parity_valid,
    k % 4 AS ssm_int, (event_id * 31 + k * 977) % 524288 AS data_bits_int, CAST(3 AS BIGINT) AS data_bytes FROM ev"""))
def word_parity_bits(spark, sf):
    return proxy.evidence(spark, sf).select(
        "event_id", "raw_hex", scalars.parity_valid(F.col("raw_hex")).alias("parity_valid"),
        scalars.bits_to_int(F.col("ssm_bits")).alias("ssm_int"), scalars.bits_to_int(F.col("data_bits")).alias("data_bits_int"),
        scalars.bits_to_bytes(F.col("data_bits")).alias("data_bytes"),
    )


@query("severity_and_risk", with_ev(f"""SELECT event_id, anomaly_score, severity, {o.canonical_severity('severity')} AS canonical,
    {o.severity_bucket('severity')} AS bucket, {o.severity_rank('severity')} AS severity_rank, {o.risk('anomaly_score', 'severity')} AS risk,
    {BUCKET} * CAST(0.005 AS DOUBLE) AS score_bucket FROM ev"""))
def severity_and_risk(spark, sf):
    s = F.col("severity")
    return proxy.evidence(spark, sf).select(
        "event_id", "anomaly_score", scalars.severity_band(F.col("anomaly_score")).alias("severity"),
        scalars.canonical_severity(s).alias("canonical"), scalars.severity_bucket(s).alias("bucket"),
        scalars.severity_rank(s).alias("severity_rank"), scalars.risk_score(F.col("anomaly_score"), s).alias("risk"),
        scalars.score_bucket(F.col("anomaly_score")).alias("score_bucket"),
    )


# --- normalised graph events: evidence, security events and attempts ---------------------------

NORMALIZED = f"""
n_ev AS (
  SELECT CASE WHEN false THEN '' ELSE 'anomaly' END AS event_type, sequence, domain, {o.canonical_severity('severity')} AS severity,
         {o.risk('anomaly_score', 'severity')} AS risk, anomaly_score, src AS source_component, dst || ':' || port AS target_component,
         {o.title("replace(anomaly_type, '_', ' ')")} AS pattern, occurred_at AS timestamp, occurred_us AS event_us,
         coalesce(nullif(explanation, ''), {o.title("replace(anomaly_type, '_', ' ')")}) AS description,
         protocol || ':' || port AS flow, protocol AS observed
  FROM ev),
n_sec AS (
  SELECT CASE WHEN event IN ('tamper_attempt_blocked', 'tamper_attempt_no_effect') OR details_operation IS NOT NULL THEN 'mutation_attempt' ELSE 'chain_integrity' END AS event_type,
         sequence, 'integrity' AS domain, {o.canonical_severity('severity')} AS severity,
         {o.risk('NULL::DOUBLE', 'severity')} AS risk, NULL::DOUBLE AS anomaly_score,
         CASE WHEN details_operation IS NOT NULL THEN CASE WHEN details_actor = 'analyst' THEN '203.0.113.45' ELSE regexp_extract(details_actor, '\\[(.*)\\]', 1) END
              ELSE details_actor END AS source_component,
         CASE WHEN details_operation IS NOT NULL THEN 'SEQ #' || details_target_sequence
              ELSE 'Evidence Chain #' || sequence END AS target_component,
         CASE WHEN details_operation IS NOT NULL
              THEN 'DB ' || {o.title('details_operation')} || ' Attempt ' || CASE WHEN event LIKE '%blocked%' THEN 'Blocked' ELSE 'Recorded' END
              ELSE {o.title("replace(event, '_', ' ')")} END AS pattern,
         created_at AS timestamp, occurred_us AS event_us, event AS description, 'TRAFFIC' AS flow, 'observed' AS observed
  FROM sec),
n_att AS (
  SELECT 'mutation_attempt' AS event_type, target_sequence AS sequence, 'integrity' AS domain, 'MEDIUM' AS severity,
         {o.risk('NULL::DOUBLE', "'ANOMALY'")} AS risk, NULL::DOUBLE AS anomaly_score,
         coalesce(attacker_ip, '203.0.113.45') AS source_component, 'SEQ #' || target_sequence AS target_component,
         'DB ' || {o.title('operation')} || ' Attempt Blocked' AS pattern, detected_at AS timestamp, occurred_us AS event_us,
         'DB ' || {o.title('operation')} || ' Attempt Blocked' AS description, 'TRAFFIC' AS flow, 'observed' AS observed
  FROM att),
n_all AS (SELECT * FROM n_ev UNION ALL SELECT * FROM n_sec UNION ALL SELECT * FROM n_att),
norm AS (
  SELECT *, event_type || '-' || sequence AS event_id,
         CASE event_type WHEN 'mutation_attempt' THEN 'DB Mutation Attempt' WHEN 'chain_integrity' THEN 'Chain Integrity' ELSE 'AI Alert' END
           || ' #' || sequence || ' [' || {o.title('severity')} || ']' AS label
  FROM n_all)
"""


def normalized(spark, sf):
    """Every evidence record, security event and attempt as a graph event."""
    mixed = feeds.unify(
        proxy.evidence(spark, sf),
        proxy.security_events(spark, sf).withColumn("event_type", F.lit("security_event")),
        feeds.attempt_events(proxy.attempts(spark, sf)),
    )
    return events.normalize_events(mixed)


NORM_COLUMNS = "event_id, sequence, event_type, domain, severity, risk, source_component, target_component, pattern, timestamp, event_us, label, description, flow, observed"


@query("normalized_events", with_ev(f"SELECT {NORM_COLUMNS} FROM norm", NORMALIZED))
def normalized_events(spark, sf):
    return normalized(spark, sf).select(*NORM_COLUMNS.split(", "))


@query("labels_and_themes", with_ev("""SELECT event_id, domain AS source_label, upper(protocol) AS volume_label,
    CASE WHEN anomaly_type <> 'none' THEN replace(anomaly_type, '_', ' ') ELSE domain END AS family_label,
    CASE WHEN data_format = 'ARINC429' THEN 'ARINC ' || CASE WHEN label_octal IN ('206', '360') THEN label_octal ELSE '206' END ELSE upper(protocol) END AS protocol_label,
    CASE WHEN source_type = 'SECURITY_EVENT' AND false THEN '' ELSE 'CSV' END AS source_kind, 1 AS source_rank,
    CASE WHEN k % 3 = 0 THEN 'Model threshold' WHEN k % 3 = 1 THEN 'Payload size' ELSE 'Traffic burst' END AS theme,
    CASE WHEN source_type = 'SECURITY_EVENT' THEN 'Event' ELSE 'Offset' END AS offset_unit FROM ev"""))
def labels_and_themes(spark, sf):
    ev = proxy.evidence(spark, sf)
    kind = scalars.source_kind(F.col("source_type"), F.col("source_file"))
    return ev.select(
        "event_id", scalars.source_label(ev).alias("source_label"), scalars.volume_label(ev).alias("volume_label"),
        scalars.family_label(ev).alias("family_label"), scalars.protocol_label(ev).alias("protocol_label"),
        kind.alias("source_kind"), scalars.source_rank(kind).alias("source_rank"),
        scalars.reason_theme(F.get("top_features", F.lit(0))).alias("theme"),
        scalars.offset_unit(F.lit(""), F.col("source_type")).alias("offset_unit"),
    )


@query("audit_labels", with_ev(f"""SELECT sequence, {o.title("replace(event, '_', ' ')")} AS title,
    CASE WHEN event LIKE '%blocked%' THEN 'Blocked' WHEN event LIKE '%restore%' OR event LIKE '%recovery%' THEN 'Recovery'
         WHEN event LIKE '%tamper%' THEN 'Detected' ELSE {o.title('severity')} END AS status,
    severity IN ('CRITICAL', 'HIGH') OR regexp_matches(event || ' ' || coalesce(details_operation, ''), 'tamper|corrupt|delete|update|failed|failure') AS critical,
    CASE WHEN details_actor = 'analyst' THEN NULL ELSE regexp_extract(details_actor, '\\[(.*)\\]', 1) END AS actor_ip FROM sec"""))
def audit_labels(spark, sf):
    sec = proxy.security_events(spark, sf)
    return sec.select(
        "sequence", scalars.audit_title(sec.drop("kind")).alias("title"), scalars.audit_status(sec.drop("kind", "source_type")).alias("status"),
        scalars.is_critical(F.col("event"), F.col("severity"), F.col("details_operation")).alias("critical"),
        scalars.ip_from_text(F.col("details_actor")).alias("actor_ip"),
    )


@query("redacted_pages", """SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)\\b[a-f0-9]{32,}\\b') THEN '[redacted]' ELSE html END AS html FROM pages""")
def redacted_pages(spark, sf):
    return proxy.table(spark, sf, "pages").select("page_id", "url", text.redact_text(F.col("html")).alias("html"))


@query("redacted_documents", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b[a-f0-9]{32,}\\b') THEN '[redacted]' ELSE text END AS text,
    regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '^ +| +$', '', 'g') AS clean FROM documents""")
def redacted_documents(spark, sf):
    return proxy.table(spark, sf, "documents").select("doc_id", text.redact_text(F.col("text")).alias("text"), text.clean_ws(F.col("text")).alias("clean"))


@query("redacted_metadata", with_ev("""SELECT event_id, 3 AS keys_kept, src AS src, label_octal AS label, 
    CASE WHEN k % 2 = 0 THEN '[redacted]' ELSE 'short' END AS note FROM ev"""))
def redacted_metadata(spark, sf):
    """Secret-looking keys dropped and long hex values masked in a metadata map."""
    ev = proxy.evidence(spark, sf)
    meta = F.create_map(
        F.lit("src"), F.col("src"), F.lit("label"), F.col("label_octal"),
        F.lit("note"), F.when(F.col("k") % 2 == 0, crypto.digest(F.col("src"))).otherwise("short"),
        F.lit("payload_sha256"), F.lit("x"), F.lit("rsa_signature"), F.lit("y"), F.lit("api_key"), F.lit("z"),
    )
    clean = ev.select("event_id", text.redact_map(meta).alias("m"))
    return clean.select("event_id", F.size("m").alias("keys_kept"), F.col("m.src").alias("src"), F.col("m.label").alias("label"), F.col("m.note").alias("note"))


TOKEN_IP = "(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query("ip_mentions", f"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'),
    lambda t: regexp_replace(t, '^[\\[\\](),;:]+|[\\[\\](),;:]+$', '', 'g')), lambda t: regexp_full_match(t, '{TOKEN_IP}'))[1] AS address FROM documents""")
def ip_mentions(spark, sf):
    return proxy.table(spark, sf, "documents").select("doc_id", scalars.ip_from_text(F.col("text")).alias("address"))


@query("question_sequences", """WITH f AS (SELECT conv_id, turn, regexp_extract_all(text, '(?i)(?:seq(?:uence)?[ \\t\\n\\r\\f]*#?[ \\t\\n\\r\\f]*|#)([0-9]+)', 1) AS tagged,
      list_filter(regexp_extract_all(text, '[0-9A-Za-z_]+'), lambda t: regexp_full_match(t, '[0-9]{2,6}')) AS bare FROM conversations),
    g AS (SELECT conv_id, turn, CASE WHEN len(tagged) > 0 THEN tagged ELSE bare END AS found FROM f),
    u AS (SELECT conv_id, turn, unnest(found) AS v, generate_subscripts(found, 1) AS i FROM g),
    d AS (SELECT conv_id, turn, CAST(v AS BIGINT) AS v, min(i) AS i FROM u GROUP BY conv_id, turn, CAST(v AS BIGINT)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM d),
    s AS (SELECT conv_id, turn, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS sequences FROM r GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn, coalesce(sequences, '') AS sequences FROM conversations c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn""")
def question_sequences(spark, sf):
    found = F.transform(text.extract_sequences(F.col("text")), lambda v: v.cast("string"))
    return proxy.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("sequences"))


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _routes() -> str:
    from evidence_spark import policy

    talk = ", ".join(f"'{t}'" for p in policy.SMALL_TALK for t in (p, f"bb {p}", f"{p} bb"))
    words = ", ".join(f"'{p}'" for p in policy.SMALL_TALK)
    greet = ", ".join(f"'{p}'" for p in policy.GREETINGS)
    return f"""WITH q AS (SELECT conv_id, turn, text, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS l FROM conversations),
    n AS (SELECT *, regexp_replace(l, '^[ .!?]+|[ .!?]+$', '', 'g') AS t,
          len(regexp_extract_all(text, '(?i)(?:seq(?:uence)?[ \\t\\n\\r\\f]*#?[ \\t\\n\\r\\f]*|#)([0-9]+)', 1)) > 0
          OR len(list_filter(regexp_extract_all(text, '[0-9A-Za-z_]+'), lambda t: regexp_full_match(t, '[0-9]{{2,6}}'))) > 0 AS has_seq FROM q),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> '') AS toks FROM n)
    SELECT conv_id, turn, CASE WHEN l = '' THEN 'empty' WHEN has_seq THEN 'sequence' WHEN {_any('l', policy.ATTACK_TERMS)} THEN 'attack_path'
      WHEN t IN ({talk}) OR (len(toks) > 0 AND len(list_filter(toks, lambda x: x IN ({greet}))) > 0 AND len(list_filter(toks, lambda x: x NOT IN ({words}))) = 0) THEN 'small_talk'
      WHEN {_any('l', policy.GUIDANCE_TERMS)} THEN 'guidance' ELSE 'other' END AS route FROM w"""


@query("question_routes", _routes())
def question_routes(spark, sf):
    return proxy.table(spark, sf, "conversations").select("conv_id", "turn", text.route_question(F.col("text")).alias("route"))


@query("canonical_hashes", with_ev("""SELECT event_id, payload AS canonical, sha256(payload) AS payload_sha256,
    to_base64(encode(payload)) AS payload_b64, length(payload) AS chars FROM logsrc"""))
def canonical_hashes(spark, sf):
    ev = proxy.evidence(spark, sf)
    body = ev.select("event_id", proxy.payload(ev).alias("canonical"))
    coded = body.withColumn("payload_b64", crypto.b64(F.col("canonical").cast("binary")))
    return coded.select(
        "event_id", "canonical", crypto.digest(F.col("canonical")).alias("payload_sha256"), "payload_b64",
        F.length(crypto.payload_text(crypto.unb64(F.col("payload_b64")))).cast("bigint").alias("chars"),
    )


@query("payload_roundtrip", with_ev("""SELECT event_id, payload AS plaintext, true AS payload_auth_valid, true AS wrong_context_refused FROM logsrc"""))
def payload_roundtrip(spark, sf):
    """Encrypt every payload bound to its origin, read it back, and try a wrong origin."""
    src = proxy.log_source(spark, sf)
    key = F.unhex(F.sha2(F.lit("fixture key"), 256))
    aad = crypto.associated_data(F.col("source_file"), F.col("source_type"), F.col("source_offset"), F.col("metadata_json"))
    nonce = F.substring(F.unhex(F.sha2(F.concat("source_file", F.col("source_offset").cast("string")), 256)), 1, 12)
    sealed = crypto.encrypt_payloads(src, key, aad, nonce=nonce)
    opened = crypto.decrypt_payloads(sealed, key, aad)
    wrong = F.try_aes_decrypt(F.col("payload"), key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(aad, F.lit("x")))
    return opened.select(
        F.col("source_offset").alias("event_id"), F.col("plaintext").cast("string").alias("plaintext"), "payload_auth_valid",
        wrong.isNull().alias("wrong_context_refused"),
    )


@query("source_keys", with_ev("""SELECT DISTINCT source_file, '/data/' || source_file AS source_key FROM ev"""))
def source_keys(spark, sf):
    ev = proxy.evidence(spark, sf)
    return aggregates.sources(ev).select("source_file", scalars.canonical_source(F.concat(F.lit("./x/../"), F.col("source_file")), "/data").alias("source_key"))


@query("parsed_times", with_ev("""SELECT event_id, occurred_us, occurred_us AS parsed_us, CAST(occurred_us AS DOUBLE) / 1000 AS millis, occurred_us AS fallback_us FROM ev"""))
def parsed_times(spark, sf):
    ev = proxy.evidence(spark, sf)
    zoned = F.concat("occurred_at", F.when(F.col("k") % 2 == 0, "Z").otherwise(""))
    broken = scalars.parse_time(F.lit("not a time"), F.timestamp_micros("occurred_us"))
    return ev.select(
        "event_id", "occurred_us", F.unix_micros(scalars.parse_time(zoned)).alias("parsed_us"),
        scalars.epoch_millis(zoned).alias("millis"), F.unix_micros(broken).alias("fallback_us"),
    )


# --- filters -------------------------------------------------------------------------------------

@query("graph_filter", with_ev(f"""SELECT {NORM_COLUMNS} FROM norm WHERE severity IN ('HIGH', 'MEDIUM') AND domain IN ('cabin', 'afdx', 'integrity')
    AND event_type IN ('anomaly', 'mutation_attempt') AND event_us >= epoch_us(TIMESTAMP '2024-01-31 00:00:00') - 20 * CAST(86400000000 AS BIGINT)""", NORMALIZED))
def graph_filter(spark, sf):
    now = F.timestamp_micros(F.lit(1706659200000000))
    kept = filters.filter_events(
        normalized(spark, sf), severity_levels=["high", "MEDIUM"], domains=["cabin", "afdx", "integrity"],
        event_types=["anomaly", "mutation_attempt"], time_window_ms=20 * 86_400_000, now=now,
    )
    return kept.select(*NORM_COLUMNS.split(", "))


@query("risk_filter", with_ev(f"SELECT {NORM_COLUMNS} FROM norm WHERE risk >= 0.7", NORMALIZED))
def risk_filter(spark, sf):
    return filters.filter_events(normalized(spark, sf), severity_threshold=0.7).select(*NORM_COLUMNS.split(", "))


@query("evidence_search", with_ev(f"""SELECT sequence, severity, src, dst FROM ev WHERE {o.severity_bucket('severity')} = 'medium'
    AND contains(lower(concat_ws(' ', CAST(sequence AS VARCHAR), protocol, src, dst, nullif(explanation, ''))), '10.0.1')"""))
def evidence_search(spark, sf):
    ev = filters.filter_severity(proxy.evidence(spark, sf), "medium")
    return filters.search(ev, " 10.0.1 ", ["sequence", "protocol", "src", "dst", "explanation"]).select("sequence", "severity", "src", "dst")


@query("replay_filter", with_ev("SELECT sequence, domain, predicted_anomaly FROM ev WHERE domain = 'afdx' AND predicted_anomaly = 1"))
def replay_filter(spark, sf):
    return filters.filter_replay(proxy.evidence(spark, sf), "afdx", True).select("sequence", "domain", "predicted_anomaly")


@query("point_lookup", with_ev("SELECT sequence, source_file, source_offset, payload FROM logsrc WHERE sequence = 41"))
def point_lookup(spark, sf):
    src = proxy.log_source(spark, sf).withColumnRenamed("order_id", "sequence")
    return filters.entry(src, 41).select("sequence", "source_file", "source_offset", F.col("payload").cast("string").alias("payload"))


@query("security_only", with_ev("SELECT sequence, source_type, created_at FROM logsrc WHERE source_type = 'SECURITY_EVENT'"))
def security_only(spark, sf):
    return filters.security_only(proxy.log_source(spark, sf)).select(F.col("order_id").alias("sequence"), "source_type", "created_at")


@query("unsynced_attempts", with_ev("SELECT attempt_id, operation, target_sequence FROM att WHERE chain_entry_hash IS NULL"))
def unsynced_attempts(spark, sf):
    return filters.unsynced_attempts(proxy.attempts(spark, sf)).select("attempt_id", "operation", "target_sequence")


@query("last_hour", with_ev("""SELECT sequence, occurred_us FROM ev WHERE occurred_us BETWEEN (SELECT max(occurred_us) FROM ev) - 3600 * CAST(1000000 AS BIGINT) AND (SELECT max(occurred_us) FROM ev)"""))
def last_hour(spark, sf):
    from evidence_spark import policy

    ev = proxy.evidence(spark, sf)
    end = ev.agg(F.max("occurred_us")).first()[0]
    return filters.last_window(ev, "occurred_us", end, policy.WINDOW_PRESETS_MS["1h"]).select("sequence", "occurred_us")


# --- joins -----------------------------------------------------------------------------------------

@query("labels_join", """SELECT d.doc_id, coalesce(l.toxic, 0) AS is_anomaly FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def labels_join(spark, sf):
    docs = proxy.table(spark, sf, "documents").select("doc_id")
    labels = proxy.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("is_anomaly"))
    return joins.attach_labels(docs, labels, ["doc_id"])


@query("bit_fields_join", with_ev("SELECT source_file, source_offset, ssm_bits, data_bits, raw_hex, CAST(0 AS BIGINT) AS misses FROM ev WHERE data_format = 'ARINC429'"))
def bit_fields_join(spark, sf):
    words = proxy.evidence(spark, sf).filter(F.col("data_format") == "ARINC429")
    hits, misses = joins.attach_bit_fields(words.select("source_file", "source_offset"), words)
    return hits.withColumn("misses", F.lit(misses.count()))


@query("zscores", with_ev("""SELECT event_id, domain, round(greatest((packet_size - coalesce(pm, 0)) / coalesce(ps, 1), 0), 6) AS packet_size_zscore,
    round(greatest((frequency - coalesce(fm, 0)) / coalesce(fs, 1), 0), 6) AS frequency_zscore FROM flagged_ev LEFT JOIN stats USING (domain)""", ZSTATS))
def zscores(spark, sf):
    ev = proxy.evidence(spark, sf)
    z = joins.apply_zscores(ev, aggregates.domain_baseline(ev), "domain", ["packet_size", "frequency"])
    return z.select("event_id", "domain", F.round("packet_size_zscore", 6).alias("packet_size_zscore"), F.round("frequency_zscore", 6).alias("frequency_zscore"))


@query("word_zscores", with_ev("""SELECT event_id, label_octal, round((b - avg(b) OVER (PARTITION BY label_octal)) / greatest(stddev_pop(b) OVER (PARTITION BY label_octal), 1), 6) AS data_bits_zscore
    FROM (SELECT *, (event_id * 31 + k * 977) % 524288 AS b FROM ev WHERE data_format = 'ARINC429')"""))
def word_zscores(spark, sf):
    words = proxy.evidence(spark, sf).filter(F.col("data_format") == "ARINC429").withColumn("data_bits_int", scalars.bits_to_int(F.col("data_bits")))
    stats = aggregates.label_baseline(words, key="label_octal")
    z = joins.apply_zscores(words, stats, "label_octal", ["data_bits_int"], upper_tail_only=False)
    return z.select("event_id", "label_octal", F.round("data_bits_int_zscore", 6).alias("data_bits_zscore"))
