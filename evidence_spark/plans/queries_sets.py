"""Aggregations, ordered operators, top-k views and unions over the evidence view."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import crypto, scalars
from evidence_spark.operators import aggregates, feeds, filters, joins, ordered
from evidence_spark.plans import oracle as o
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.queries_rows import NORMALIZED, normalized
from evidence_spark.plans.registry import query

def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def logsrc(spark, sf):
    return proxy.log_source(spark, sf).withColumnRenamed("order_id", "sequence").withColumn("payload_sha256", F.sha2("payload", 256))


def recorded(spark, sf):
    return proxy.evidence(spark, sf).withColumn("recorded_at", F.col("occurred_at"))


# --- aggregations --------------------------------------------------------------------------------

@query("domain_baseline", with_ev("""SELECT domain, round(avg(packet_size), 6) AS packet_size_mean, round(greatest(stddev_pop(packet_size), 1), 6) AS packet_size_std,
    round(avg(frequency), 6) AS frequency_mean, round(greatest(stddev_pop(frequency), 1), 6) AS frequency_std FROM ev WHERE is_anomaly = 0 GROUP BY domain"""))
def domain_baseline(spark, sf):
    stats = aggregates.domain_baseline(proxy.evidence(spark, sf))
    return rounded(stats, "packet_size_mean", "packet_size_std", "frequency_mean", "frequency_std")


@query("ingest_summary", with_ev("SELECT domain, data_format, is_anomaly, count(*) AS rows, round(avg(frequency), 6) AS mean_frequency FROM ev GROUP BY ALL"))
def ingest_summary(spark, sf):
    return rounded(aggregates.ingest_summary(proxy.evidence(spark, sf)), "mean_frequency")


@query("chain_head", with_ev("SELECT max(sequence) AS sequence, count(*) AS entry_count, arg_max(sha256(payload), sequence) AS head_hash FROM logsrc"))
def chain_head(spark, sf):
    from evidence_spark.operators import integrity

    return integrity.chain_head(logsrc(spark, sf).withColumn("entry_hash", F.col("payload_sha256")))


@query("source_summary", with_ev("""SELECT source_file, source_type, count(*) AS records, min(created_at) AS first_seen, max(created_at) AS last_seen,
    min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM logsrc GROUP BY ALL"""))
def source_summary(spark, sf):
    return aggregates.source_summary(logsrc(spark, sf))


@query("evidence_totals", with_ev("""SELECT count(*) AS total_records, CAST(sum(predicted_anomaly) AS BIGINT) AS anomalies, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score,
    count(*) AS total_entries, CAST(count(*) FILTER (source_type = 'SECURITY_EVENT') AS BIGINT) AS security_events_count, CAST(count(*) - sum(predicted_anomaly) AS BIGINT) AS normal,
    CAST(sum(predicted_anomaly) + count(*) FILTER (source_type = 'SECURITY_EVENT') AS BIGINT) AS total_alerts FROM ev"""))
def evidence_totals(spark, sf):
    return aggregates.evidence_totals(proxy.evidence(spark, sf), logsrc(spark, sf))


@query("severity_counts", with_ev("SELECT coalesce(severity, 'UNKNOWN') AS severity, count(*) AS count FROM ev GROUP BY 1"))
def severity_counts(spark, sf):
    return aggregates.severity_counts(proxy.evidence(spark, sf))


@query("severity_bucket_counts", with_ev(f"SELECT {o.severity_bucket('severity')} AS severity, count(*) AS count FROM ev GROUP BY 1"))
def severity_bucket_counts(spark, sf):
    return aggregates.severity_bucket_counts(proxy.evidence(spark, sf))


@query("log_span", with_ev("SELECT count(*) AS total_entries, min(created_at) AS first_seen, max(created_at) AS last_seen FROM logsrc"))
def log_span(spark, sf):
    return aggregates.log_span(logsrc(spark, sf))


@query("confusion_by_domain", with_ev("""SELECT domain, count(*) FILTER (is_anomaly = 1 AND predicted_anomaly = 1) AS tp, count(*) FILTER (is_anomaly = 0 AND predicted_anomaly = 1) AS fp,
    count(*) FILTER (is_anomaly = 1 AND predicted_anomaly = 0) AS fn, count(*) FILTER (is_anomaly = 0 AND predicted_anomaly = 0) AS tn,
    round(avg(anomaly_score) FILTER (is_anomaly = 0), 6) AS mean_score_normal, round(avg(anomaly_score) FILTER (is_anomaly = 1), 6) AS mean_score_anomaly,
    round(tp / (tp + fn), 6) AS detection_rate, round(fp / (fp + tn), 6) AS false_positive_rate, round((tp + tn) / count(*), 6) AS accuracy FROM ev GROUP BY domain"""))
def confusion_by_domain(spark, sf):
    table = aggregates.evaluate(proxy.evidence(spark, sf), ["domain"])
    return rounded(table, "mean_score_normal", "mean_score_anomaly", "detection_rate", "false_positive_rate", "accuracy")


@query("composition", with_ev("SELECT protocol AS label, count(*) AS count FROM ev GROUP BY 1"))
def composition(spark, sf):
    return aggregates.composition(proxy.evidence(spark, sf), F.col("protocol"))


@query("severity_trend", with_ev(f"""SELECT CAST(occurred_us // 60000000 * 60000000 AS BIGINT) AS bucket_us, count(*) FILTER ({o.severity_rank('severity')} >= 3) AS high,
    count(*) FILTER ({o.severity_rank('severity')} = 2) AS medium, count(*) FILTER ({o.severity_rank('severity')} < 2) AS low FROM ev WHERE predicted_anomaly = 1 GROUP BY 1"""))
def severity_trend(spark, sf):
    return aggregates.severity_trend(proxy.evidence(spark, sf))


def _top(label: str, n: int, where: str = "predicted_anomaly = 1") -> str:
    return with_ev(f"SELECT {label} AS label, count(*) AS count FROM ev WHERE {where} GROUP BY 1 ORDER BY count DESC, label LIMIT {n}")


@query("top_sources", _top("domain", 8))
def top_sources(spark, sf):
    return aggregates.top_sources(proxy.evidence(spark, sf))


@query("volume_breakdown", _top("upper(protocol)", 10))
def volume_breakdown(spark, sf):
    return aggregates.volume_breakdown(proxy.evidence(spark, sf))


@query("family_breakdown", _top("CASE WHEN anomaly_type <> 'none' THEN replace(anomaly_type, '_', ' ') ELSE domain END", 8))
def family_breakdown(spark, sf):
    return aggregates.family_breakdown(proxy.evidence(spark, sf))


@query("top_reason_themes", with_ev("""SELECT CASE f WHEN 'none' THEN 'Model threshold' WHEN 'packet_size_zscore' THEN 'Payload size' WHEN 'port_anomaly_flag' THEN 'Port misuse'
    WHEN 'frequency' THEN 'Traffic burst' WHEN 'cross_domain_flag' THEN 'Cross-domain movement' END AS label, count(*) AS count
    FROM (SELECT unnest(CASE WHEN len(top_features) = 0 THEN ['none'] ELSE top_features END) AS f FROM ev WHERE predicted_anomaly = 1) GROUP BY 1 ORDER BY count DESC, label LIMIT 8"""))
def top_reason_themes(spark, sf):
    return aggregates.top_reason_themes(proxy.evidence(spark, sf))


@query("severity_distribution", with_ev(f"""SELECT CASE WHEN predicted_anomaly = 0 THEN 'Normal' ELSE ['Normal','Low','Medium','High'][{o.severity_rank('severity')} + 1] END AS label, count(*) AS count FROM ev GROUP BY 1"""))
def severity_distribution(spark, sf):
    return aggregates.severity_distribution(proxy.evidence(spark, sf))


@query("posture", with_ev(f"""SELECT count(*) AS total, count(*) FILTER (predicted_anomaly = 1) AS flagged, count(*) FILTER (predicted_anomaly = 1 AND severity = 'HIGH') AS high,
    count(*) FILTER (predicted_anomaly = 1 AND severity = 'MEDIUM') AS medium, count(*) FILTER (predicted_anomaly = 1 AND severity = 'LOW') AS low,
    flagged / total AS alert_rate, CASE WHEN alert_rate >= 0.15 THEN 'Critical' WHEN alert_rate >= 0.05 THEN 'Elevated' WHEN alert_rate >= 0.01 THEN 'Caution' ELSE 'Safe' END AS posture,
    total - flagged AS normal FROM ev"""))
def posture(spark, sf):
    return aggregates.posture(proxy.evidence(spark, sf))


@query("intake_totals", with_ev("SELECT CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS capture_chunks FROM logsrc"))
def intake_totals(spark, sf):
    return aggregates.intake_totals(aggregates.source_summary(logsrc(spark, sf)))


@query("graph_statistics", with_ev("""SELECT attribute, value, count(*) AS events FROM (
    SELECT unnest(['domain','severity','pattern','event_type']) AS attribute, unnest([domain, severity, pattern, event_type]) AS value FROM norm WHERE risk >= 0.5) GROUP BY ALL""", NORMALIZED))
def graph_statistics(spark, sf):
    return aggregates.graph_stats(filters.filter_events(normalized(spark, sf)))


@query("risk_stats", with_ev(f"""SELECT count(*) AS anomalies, count(*) FILTER (risk > 0.8) AS critical_anomalies, count(*) FILTER (risk > 0.6 AND risk <= 0.8) AS high_risk_anomalies,
    max(risk) AS max_risk, round(avg(risk), 6) AS avg_risk, {o.half_up('avg(risk)', 4)} AS mean_risk FROM norm WHERE risk >= 0.5""", NORMALIZED))
def risk_stats(spark, sf):
    kept = filters.filter_events(normalized(spark, sf))
    both = aggregates.risk_stats(kept).withColumn("mean_risk", scalars.round_half_up(F.col("avg_risk"), 4))
    return rounded(both, "avg_risk")


@query("domain_cards", with_ev("SELECT domain, count(*) AS events, CAST(sum(predicted_anomaly) AS BIGINT) AS flagged, CASE WHEN sum(predicted_anomaly) > 0 THEN 'incident' ELSE 'clean' END AS state FROM ev GROUP BY domain"))
def domain_cards(spark, sf):
    return aggregates.domain_cards(proxy.evidence(spark, sf))


@query("readiness_report", with_ev("""SELECT count(*) AS evidence_items, count(*) FILTER (explanation <> '' OR len(top_features) > 0) AS explained_items,
    true AS chain_ready, false AS recovery_ready, explained_items > 0 AS report_ready, 1 + 2 * CAST(explained_items > 0 AS INTEGER) AS ready_count FROM ev"""))
def readiness_report(spark, sf):
    return aggregates.readiness_report(proxy.evidence(spark, sf), True, False)


# --- ordered operators -------------------------------------------------------------------------------

@query("arrival_rate", with_ev("""SELECT sequence, domain, CAST(trunc(coalesce(rate, median(rate) OVER (PARTITION BY domain))) AS BIGINT) AS whole_rate,
      round(coalesce(rate, median(rate) OVER (PARTITION BY domain)), 9) AS frequency
    FROM (SELECT sequence, domain, CASE WHEN before IS NOT NULL THEN least(1 / greatest(CAST(occurred_us - before AS DOUBLE) / 1000000, 0.0001), 10000) END AS rate
      FROM (SELECT *, lag(occurred_us) OVER (PARTITION BY domain ORDER BY occurred_us, sequence) AS before FROM ev))"""))
def arrival_rate(spark, sf):
    ev = proxy.evidence(spark, sf).select("sequence", "domain", "occurred_us")
    rate = ordered.arrival_rate(ev, "domain", "occurred_us", "sequence")
    return rate.select("sequence", "domain", F.col("frequency").cast("bigint").alias("whole_rate"), F.round("frequency", 9).alias("frequency"))


@query("rolling_count", with_ev("""SELECT sequence, domain, count(*) OVER (PARTITION BY domain ORDER BY occurred_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)
    - (count(*) OVER (PARTITION BY domain, occurred_us) - row_number() OVER (PARTITION BY domain, occurred_us ORDER BY sequence)) AS frequency FROM ev"""))
def rolling_count(spark, sf):
    """Rows of the domain in the trailing hour; the events are too sparse for seconds."""
    ev = proxy.evidence(spark, sf).select("sequence", "domain", "occurred_us")
    return ordered.rolling_count(ev, ["domain"], "occurred_us", "sequence", 3600).drop("occurred_us")


@query("rolling_count_by_supplier", """SELECT l_returnflag, n, count(*) OVER (PARTITION BY l_returnflag ORDER BY epoch_us(l_shipdate) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)
    - (count(*) OVER (PARTITION BY l_returnflag, l_shipdate) - row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY n)) AS frequency
    FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)""")
def rolling_count_by_supplier(spark, sf):
    """The same count on a table with heavy ties and three large groups."""
    li = proxy.table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    numbered = ordered.global_sequence(li.select(*order), order, "n").select("n", "l_returnflag", proxy.micros("l_shipdate").alias("at"))
    return ordered.rolling_count(numbered, ["l_returnflag"], "at", "n", 7 * 86_400).drop("at")


@query("link_check", with_ev("""SELECT sequence, coalesce(lag(h) OVER (ORDER BY sequence), repeat('0', 64)) AS expected_previous_hash,
    p = coalesce(lag(h) OVER (ORDER BY sequence), repeat('0', 64)) AS previous_hash_matches
    FROM (SELECT sequence, sha256(CAST(sequence AS VARCHAR)) AS h, CASE WHEN sequence % 97 = 0 THEN 'edited' WHEN sequence = 1 THEN repeat('0', 64) ELSE sha256(CAST(sequence - 1 AS VARCHAR)) END AS p FROM ev)"""))
def link_check(spark, sf):
    """Links between stored hashes, every 97th one edited."""
    ev = proxy.evidence(spark, sf)
    own = F.sha2(F.col("sequence").cast("string"), 256)
    before = F.when(F.col("sequence") == 1, "0" * 64).otherwise(F.sha2((F.col("sequence") - 1).cast("string"), 256))
    rows = ev.select("sequence", own.alias("entry_hash"), F.when(F.col("sequence") % 97 == 0, "edited").otherwise(before).alias("previous_hash"))
    return ordered.link_check(rows).select("sequence", "expected_previous_hash", "previous_hash_matches")


@query("sequence_gaps", with_ev("""SELECT sequence, expected_sequence FROM (SELECT sequence, coalesce(lag(sequence) OVER (ORDER BY sequence), 0) + 1 AS expected_sequence FROM ev WHERE k <> 42) WHERE sequence <> expected_sequence"""))
def sequence_gaps(spark, sf):
    """Gaps left by deleted rows: all events with k = 42 are taken away first."""
    kept = proxy.evidence(spark, sf).filter(F.col("k") != 42)
    return ordered.sequence_gaps(kept)


@query("temporal_edges", with_ev("""SELECT * FROM (SELECT lag('event-' || sequence) OVER (ORDER BY occurred_us, sequence) AS source, 'event-' || sequence AS target, 'then' AS label, true AS temporal
    FROM ev WHERE predicted_anomaly = 1) WHERE source IS NOT NULL"""))
def temporal_edges(spark, sf):
    ev = filters.flagged(proxy.evidence(spark, sf)).withColumn("node", F.concat(F.lit("event-"), F.col("sequence").cast("string")))
    return ordered.temporal_edges(ev, "node", "occurred_us", "sequence")


@query("event_rank", with_ev("SELECT sequence, row_number() OVER (ORDER BY occurred_us, sequence) AS rank FROM ev"))
def event_rank(spark, sf):
    ev = proxy.evidence(spark, sf).select("sequence", "occurred_us")
    return ordered.event_rank(ev, ["occurred_us", "sequence"]).select("sequence", "rank")


@query("score_percentile", with_ev("SELECT domain, round(quantile_cont(anomaly_score, 0.05), 9) AS p05 FROM ev GROUP BY domain"))
def score_percentile(spark, sf):
    cut = ordered.exact_percentile(proxy.evidence(spark, sf), ["domain"], "anomaly_score", 0.05, "p05")
    return cut.withColumn("p05", F.round("p05", 9))


@query("price_percentile", """SELECT l_returnflag, round(median(l_extendedprice), 6) AS median_price FROM lineitem GROUP BY l_returnflag""")
def price_percentile(spark, sf):
    cut = ordered.exact_percentile(proxy.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "median_price")
    return rounded(cut, "median_price")


# --- joins against the log ---------------------------------------------------------------------------

TWICE = """twice AS (SELECT source_file, source_offset, sequence, sha256(payload) AS entry_hash, source_type, sha256(payload) AS payload_sha256, created_at FROM logsrc
  UNION ALL SELECT source_file, source_offset, sequence + 1000000000, sha256(payload || 'again'), source_type, sha256(payload), created_at FROM logsrc WHERE k < 50)"""


def twice(spark, sf):
    """A log in which half of the rows were ingested a second time."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    half = proxy.table(spark, sf, "events").filter(k < 50).select((F.col("event_id") + 1).alias("sequence"))
    log = logsrc(spark, sf).withColumn("entry_hash", F.col("payload_sha256"))
    again = log.join(half, "sequence", "left_semi").withColumn(
        "entry_hash", F.sha2(F.concat(F.col("payload").cast("string"), F.lit("again")), 256)
    ).withColumn("sequence", F.col("sequence") + 1_000_000_000)
    return log.unionByName(again)


@query("correlate_latest", with_ev("""SELECT source_file, source_offset, max(sequence) AS sequence, arg_max(entry_hash, sequence) AS entry_hash,
    arg_max(payload_sha256, sequence) AS payload_sha256 FROM twice GROUP BY ALL""", TWICE))
def correlate_latest(spark, sf):
    keys = proxy.evidence(spark, sf).select("source_file", "source_offset")
    return joins.correlate(keys, twice(spark, sf)).select("source_file", "source_offset", "sequence", "entry_hash", "payload_sha256")


@query("correlate_first", with_ev("""SELECT source_file, source_offset, min(sequence) AS sequence, arg_min(entry_hash, sequence) AS entry_hash FROM twice GROUP BY ALL""", TWICE))
def correlate_first(spark, sf):
    keys = proxy.evidence(spark, sf).select("source_file", "source_offset")
    return joins.correlate(keys, twice(spark, sf), latest=False).select("source_file", "source_offset", "sequence", "entry_hash")


@query("attach_evidence", with_ev("""SELECT count(*) FILTER (domain <> 'cabin') AS attached, count(*) FILTER (domain = 'cabin') AS missing_mappings FROM ev"""))
def attach_evidence(spark, sf):
    """Attach report when one source file was never logged."""
    log = logsrc(spark, sf).withColumn("entry_hash", F.col("payload_sha256")).filter(F.col("source_file") != "events/click.csv")
    _, report = joins.attach_evidence(proxy.evidence(spark, sf), log)
    return report


@query("replay_base", with_ev("SELECT sequence, created_at, source_type, evidence_id, severity, anomaly_score FROM logsrc"))
def replay_base(spark, sf):
    return joins.replay_base(logsrc(spark, sf), proxy.evidence(spark, sf)).select("sequence", "created_at", "source_type", "evidence_id", "severity", "anomaly_score")


@query("attach_artifact", with_ev("SELECT evidence_id, CASE WHEN k % 4 > 0 THEN src END AS artifact_src, CASE WHEN k % 4 > 0 THEN protocol END AS artifact_protocol FROM ev"))
def attach_artifact(spark, sf):
    ev = proxy.evidence(spark, sf)
    scored = ev.filter(F.col("k") % 4 > 0).select(F.lit("scored.csv").alias("artifact_path"), F.col("event_id").alias("row_index"), "src", "protocol")
    left = ev.select("evidence_id", F.lit("scored.csv").alias("ai_artifact_path"), F.col("event_id").alias("ai_artifact_row_index"))
    return joins.attach_artifact(left, scored, ["src", "protocol"]).select("evidence_id", "artifact_src", "artifact_protocol")


@query("new_attempts", with_ev("SELECT attempt_id, operation FROM att WHERE attempt_id NOT IN (SELECT attempt_id FROM sec WHERE attempt_id IS NOT NULL AND severity = 'HIGH')"))
def new_attempts(spark, sf):
    sec = proxy.security_events(spark, sf).filter(F.col("severity") == "HIGH")
    return joins.new_attempts(proxy.attempts(spark, sf), sec).select("attempt_id", "operation")


@query("missing_sources", with_ev("""SELECT DISTINCT 'events/' || domain || '.pcap' AS source_file FROM ev WHERE domain <> 'cabin'"""))
def missing_sources(spark, sf):
    """Capture files next to logged CSV files that were not ingested yet."""
    log = proxy.evidence(spark, sf).select("source_file")
    domains = proxy.evidence(spark, sf).select("domain").distinct()
    listing = domains.select(F.concat(F.lit("events/"), F.col("domain"), F.lit(".pcap")).alias("source_file")).unionByName(
        domains.select(F.concat(F.lit("elsewhere/"), F.col("domain"), F.lit(".pcap")).alias("source_file"))
    )
    logged = log.unionByName(domains.filter(F.col("domain") == "cabin").select(F.lit("./events/cabin.pcap").alias("source_file")))
    return joins.missing_sources(logged, listing, "/data")


# --- top-k -----------------------------------------------------------------------------------------------

@query("recent_entries", with_ev("SELECT sequence, source_file, sha256(payload) AS payload_sha256, 'csv_row' AS ingest_mode FROM logsrc ORDER BY sequence DESC LIMIT 25"))
def recent_entries(spark, sf):
    return feeds.recent_entries(logsrc(spark, sf)).select("sequence", "source_file", "payload_sha256", "ingest_mode")


@query("sequence_entries", with_ev("SELECT sequence, created_at, source_file, source_type, source_offset, 'csv_row' AS ingest_mode, 'Row' AS offset_label FROM logsrc"))
def sequence_entries(spark, sf):
    return feeds.sequence_entries(logsrc(spark, sf))


@query("ranked_anomalies", with_ev("SELECT evidence_id, anomaly_score, severity FROM ev WHERE predicted_anomaly = 1 ORDER BY anomaly_score, evidence_id DESC LIMIT 80"))
def ranked_anomalies(spark, sf):
    return feeds.ranked_anomalies(proxy.evidence(spark, sf), 80).select("evidence_id", "anomaly_score", "severity")


@query("score_trace", with_ev("""SELECT evidence_id, occurred_at, anomaly_score FROM (SELECT * FROM (SELECT * FROM ev ORDER BY evidence_id DESC LIMIT 160)
    UNION SELECT * FROM (SELECT * FROM ev WHERE predicted_anomaly = 1))"""))
def score_trace(spark, sf):
    return feeds.score_trace(proxy.evidence(spark, sf)).select("evidence_id", "occurred_at", "anomaly_score")


@query("latest_checkpoint", with_ev("""SELECT (evidence_id - 1) // 50 + 1 AS checkpoint_id, count(*) AS batch_size, min(evidence_id) AS first_evidence_id, max(evidence_id) AS last_evidence_id
    FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 1"""))
def latest_checkpoint(spark, sf):
    return feeds.latest_checkpoint(proxy.batches(spark, sf)).select("checkpoint_id", "batch_size", "first_evidence_id", "last_evidence_id")


@query("security_events_view", with_ev("""SELECT sequence, event, severity, '203.0.113.45' AS attacker_ip FROM sec ORDER BY sequence DESC LIMIT 50"""))
def security_events_view(spark, sf):
    sec = proxy.security_events(spark, sf)
    body = F.to_json(F.struct("event", "severity"))
    log = sec.withColumn("payload", body.cast("binary")).withColumn("metadata_json", F.lit("{}"))
    return feeds.security_events_view(log, 50).select("sequence", "event", "severity", "attacker_ip")


@query("security_events_opened", with_ev("""SELECT sequence, event, severity, '203.0.113.45' AS attacker_ip FROM sec ORDER BY sequence DESC LIMIT 50"""))
def security_events_opened(spark, sf):
    """The same view over encrypted payloads."""
    sec = proxy.security_events(spark, sf).withColumn("payload", F.to_json(F.struct("event", "severity")).cast("binary"))
    key = F.unhex(F.sha2(F.lit("fixture key"), 256))
    aad = crypto.associated_data(F.col("source_file"), F.col("source_type"), F.col("source_offset"), F.lit("{}"))
    log = crypto.encrypt_payloads(sec, key, aad).withColumn("metadata_json", F.lit("{}"))
    return feeds.security_events_view(log, 50, key, aad).select("sequence", "event", "severity", "attacker_ip")


@query("select_top", with_ev("""SELECT DISTINCT event_id, risk FROM (SELECT * FROM (SELECT event_id, risk FROM norm ORDER BY risk DESC, abs(coalesce(anomaly_score, 0)) DESC, event_us DESC, event_id LIMIT 10)
    UNION SELECT event_id, risk FROM norm WHERE event_type = 'mutation_attempt')""", NORMALIZED.replace("UNION ALL SELECT * FROM n_att", "")))
def select_top(spark, sf):
    from evidence_spark.operators import events

    mixed = feeds.unify(proxy.evidence(spark, sf), proxy.security_events(spark, sf).withColumn("event_type", F.lit("security_event")))
    return feeds.select_top(events.normalize_events(mixed), 10).select("event_id", "risk")


@query("top_evidence", with_ev("""SELECT sequence, evidence_id, severity FROM ev ORDER BY 1 - predicted_anomaly,
    CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 4 END, anomaly_score, sequence, evidence_id LIMIT 10"""))
def top_evidence(spark, sf):
    return feeds.top_evidence(proxy.evidence(spark, sf)).select("sequence", "evidence_id", "severity")


@query("recent_documents", "SELECT doc_id, CAST(1704067200 + doc_id AS BIGINT) AS uploaded_s FROM documents ORDER BY doc_id DESC LIMIT 12")
def recent_documents(spark, sf):
    docs = proxy.table(spark, sf, "documents").select("doc_id", (F.lit(1704067200) + F.col("doc_id")).alias("uploaded_at"))
    return feeds.recent_documents(docs).withColumnRenamed("uploaded_at", "uploaded_s")


@query("order_sources", with_ev("SELECT source_file, 'CSV' AS kind, split_part(source_file, '/', 2) AS name, max(created_at) AS last_seen, count(*) AS records FROM logsrc GROUP BY source_file"))
def order_sources(spark, sf):
    return feeds.order_sources(aggregates.source_summary(logsrc(spark, sf))).select("source_file", "kind", "name", "last_seen", "records")


@query("timeline", with_ev("SELECT sequence, occurred_at, predicted_anomaly FROM ev"))
def timeline(spark, sf):
    return feeds.timeline(proxy.evidence(spark, sf)).select("sequence", "occurred_at", "predicted_anomaly")


# --- unions ------------------------------------------------------------------------------------------------

FEED = f"""feed AS (
  SELECT CASE WHEN source_type = 'SECURITY_EVENT' THEN 'security_event' ELSE 'raw_log' END AS kind, 'Log' AS kind_label, created_at AS recorded_at, sequence,
         'seq-' || sequence AS record_id, CASE WHEN source_type = 'SECURITY_EVENT' THEN 'Security event appended' ELSE 'Raw log appended' END AS activity,
         source_file, source_type, 'Normal' AS classification, 'Sealed append' AS context, 'log:' || source_type || ':' || source_file AS batch_key
  FROM logsrc
  UNION ALL
  SELECT 'ai_evidence', 'AI', occurred_at, sequence, 'ai-' || evidence_id, 'AI evidence stored', source_file, 'AI_EVIDENCE',
         CASE WHEN predicted_anomaly = 1 THEN 'Critical' ELSE 'Normal' END,
         CASE WHEN predicted_anomaly = 1 THEN 'Flagged anomaly' ELSE 'Normal verdict' END || ' / ' || {o.title('severity')},
         'ai:' || CASE WHEN predicted_anomaly = 1 THEN 'Critical' ELSE 'Normal' END || ':' || source_file
  FROM ev
  UNION ALL
  SELECT 'ai_checkpoint', 'AI', created_at, last_id, 'ai-checkpoint-' || id, 'AI checkpoint stored', 'AI evidence ledger', 'AI_CHECKPOINT', 'Normal',
         n || ' records, #' || first_id || ' to #' || last_id, 'ai_checkpoint:evidence_batch'
  FROM (SELECT (evidence_id - 1) // 50 + 1 AS id, max(occurred_at) AS created_at, count(*) AS n, min(evidence_id) AS first_id, max(evidence_id) AS last_id FROM ev GROUP BY 1)
  UNION ALL
  SELECT 'mutation_attempt', 'Attempt', detected_at, target_sequence, 'attempt-' || attempt_id, {o.title('operation')} || ' attempt blocked',
         coalesce(table_name, sqlite_action), 'MUTATION_ATTEMPT', 'Critical', 'Protected table: ' || coalesce(table_name, sqlite_action),
         'attempt:' || operation || ':' || coalesce(table_name, sqlite_action)
  FROM att)"""


def feed(spark, sf):
    return feeds.activity_feed(logsrc(spark, sf), recorded(spark, sf), proxy.batches(spark, sf), proxy.attempts(spark, sf))


@query("activity_feed", with_ev("SELECT * FROM feed", FEED))
def activity_feed(spark, sf):
    return feed(spark, sf)


@query("activity_batches", with_ev("""SELECT batch_key, count(*) AS items, max(recorded_at) AS latest_at, CASE WHEN bool_or(classification = 'Critical') THEN 'Critical' ELSE 'Normal' END AS classification,
    min(kind_label) AS kind_label FROM feed GROUP BY batch_key""", FEED))
def activity_batches(spark, sf):
    return aggregates.activity_batches(feed(spark, sf))


PROV = """ranked AS (SELECT sequence, 'anomaly' AS event_type FROM ev WHERE predicted_anomaly = 1),
newest AS (SELECT * FROM sec),
prov AS (SELECT sequence, CAST(NULL AS BIGINT) AS attempt_id, 'anomaly' AS event_type FROM ranked UNION ALL SELECT sequence, attempt_id, 'security_event' FROM newest
  UNION ALL SELECT target_sequence, attempt_id, 'mutation_attempt' FROM att
  WHERE attempt_id NOT IN (SELECT attempt_id FROM newest WHERE attempt_id IS NOT NULL))"""


@query("provenance_events", with_ev("SELECT * FROM prov", PROV))
def provenance_events(spark, sf):
    both = feeds.provenance_events(proxy.evidence(spark, sf), proxy.security_events(spark, sf), proxy.attempts(spark, sf))
    return both.select("sequence", "attempt_id", F.coalesce("event_type", F.lit("anomaly")).alias("event_type"))


@query("audit_entries", with_ev(f"""SELECT lane, record_id, arg_min(sequence, (l, t, sequence)) AS sequence, arg_min(t, (l, t, sequence)) AS occurred_at, arg_min(status, (l, t, sequence)) AS audit_status,
    arg_min(severity, (l, t, sequence)) AS severity, CAST(arg_min(p, (l, t, sequence)) AS INTEGER) AS predicted_anomaly FROM (
      SELECT 'mutation' AS lane, 'attempt-' || attempt_id AS record_id, target_sequence AS sequence, detected_at AS t, 'Blocked' AS status, 'HIGH' AS severity, 1 AS p, 0 AS l FROM att
      UNION ALL SELECT CASE WHEN details_operation IS NOT NULL THEN 'mutation' ELSE 'recovery' END,
        CASE WHEN details_operation IS NOT NULL THEN CAST(attempt_id AS VARCHAR) ELSE 'seq-' || sequence END, sequence, created_at,
        CASE WHEN event LIKE '%blocked%' THEN 'Blocked' WHEN event LIKE '%restore%' THEN 'Recovery' WHEN event LIKE '%tamper%' THEN 'Detected' ELSE {o.title('severity')} END,
        CASE WHEN details_operation IS NOT NULL OR severity = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN details_operation IS NOT NULL THEN 1 ELSE 0 END, 1 FROM sec)
    GROUP BY lane, record_id"""))
def audit_entries(spark, sf):
    attempts = feeds.attempt_activity(proxy.attempts(spark, sf))
    return feeds.audit_entries(attempts, proxy.security_events(spark, sf))


@query("evidence_pool", with_ev("""SELECT sequence, evidence_id, source_file, source_offset, CASE WHEN predicted_anomaly = 1 THEN 'flagged' ELSE 'all' END AS pool FROM ev"""))
def evidence_pool(spark, sf):
    ev = proxy.evidence(spark, sf).select("sequence", "evidence_id", "source_file", "source_offset", "predicted_anomaly")
    first = filters.flagged(ev).withColumn("pool", F.lit("flagged"))
    return feeds.evidence_pool(first, ev.withColumn("pool", F.lit("all")), first.withColumn("pool", F.lit("again"))).drop("predicted_anomaly")


@query("evidence_stream", with_ev("""SELECT sequence, 'ai' AS lane FROM ev WHERE predicted_anomaly = 1 UNION ALL SELECT target_sequence, 'mutation' FROM att"""))
def evidence_stream(spark, sf):
    ai = filters.flagged(proxy.evidence(spark, sf)).select("sequence", F.lit("ai").alias("lane"))
    audit = proxy.attempts(spark, sf).select(F.col("target_sequence").alias("sequence"), F.lit("mutation").alias("lane"))
    return feeds.evidence_stream(ai, audit).select("sequence", "lane")


@query("chain_growth", with_ev("""SELECT 'entry-' || sequence AS key, 'CSV' AS type, 'Sequence #' || sequence AS title, 'Row ' || source_offset AS position, created_at AS time,
    CAST(sequence AS DOUBLE) AS rank FROM logsrc"""))
def chain_growth(spark, sf):
    log = logsrc(spark, sf)
    return feeds.chain_growth(feeds.sequence_entries(log), None, None, None)
