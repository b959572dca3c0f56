"""Evidence records, replay bundles, reports and question answering data."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import crypto
from evidence_spark.operators import aggregates, evidence, feeds, graph
from evidence_spark.plans import oracle as o
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.queries_graph import _sel, investigation_graph
from evidence_spark.plans.queries_integrity import evidence_records
from evidence_spark.plans.queries_rows import normalized
from evidence_spark.plans.queries_sets import logsrc
from evidence_spark.plans.registry import query


def verdict_input(spark, sf):
    return proxy.evidence(spark, sf).select(
        "sequence", "predicted_anomaly", "severity", F.col("data_format").alias("model_used"), F.col("occurred_at").alias("timestamp"),
        "data_format", "domain", "protocol", "src", "dst", "label_octal", "anomaly_type", F.when(F.col("k") % 8 > 0, F.col("port")).alias("port"),
    )


@query("verdicts", with_ev("""SELECT sequence, '{"anomaly_type":"' || anomaly_type || '","data_format":"' || data_format || '","domain":"' || domain || '","dst":"' || dst || '","label_octal":"' || label_octal
    || '","model_used":"' || data_format || '","occurred_at":"' || occurred_at || '",' || CASE WHEN k % 8 > 0 THEN '"port":"' || port || '",' ELSE '' END || '"predicted_anomaly":' || predicted_anomaly
    || ',"protocol":"' || protocol || '","severity":"' || severity || '","src":"' || src || '"}' AS verdict_json FROM ev"""))
def verdicts(spark, sf):
    rows = verdict_input(spark, sf)
    return rows.select("sequence", evidence.verdict(rows).alias("verdict_json"))


@query("evidence_rows", with_ev("""SELECT evidence_id, recorded_at, source_file, source_offset, sequence, 'scored.csv' AS ai_artifact_path, source_offset AS ai_artifact_row_index,
    data_format AS model_used, anomaly_score, predicted_anomaly, severity, 64 AS hash_chars FROM (SELECT *, occurred_at AS recorded_at FROM ev)"""))
def evidence_rows(spark, sf):
    return evidence_records(spark, sf).withColumn("hash_chars", F.length("ai_result_sha256")).drop("entry_hash", "ai_result_sha256", "verdict_json")


@query("evidence_view", with_ev("""SELECT evidence_id, occurred_at, sequence, source_offset AS artifact_row_index, data_format AS model_used, anomaly_score, predicted_anomaly, severity,
    data_format, domain, protocol, src, dst, label_octal, anomaly_type, CAST(port AS VARCHAR) AS port, 0 AS features FROM ev"""))
def evidence_view(spark, sf):
    view = evidence.evidence_view(evidence_records(spark, sf)).withColumn("features", F.size("top_features"))
    return view.drop("recorded_at", "source_file", "source_offset", "top_features", "explanation")


@query("correlation_map", with_ev("SELECT source_file, source_offset, sequence, source_type, sha256(payload) AS payload_sha256, created_at FROM logsrc"))
def correlation_map(spark, sf):
    return evidence.correlation_map(logsrc(spark, sf).withColumn("entry_hash", F.col("payload_sha256"))).drop("entry_hash")


REPLAY = """rp AS (SELECT sequence, occurred_at, 'ARINC 429 bus' AS source_component, 'label ' || label_octal AS target_component, 'avionics word' AS service, * EXCLUDE (sequence, occurred_at) FROM ev WHERE data_format = 'ARINC429'
  UNION ALL SELECT sequence, occurred_at, src, dst, protocol, * EXCLUDE (sequence, occurred_at) FROM ev WHERE data_format <> 'ARINC429')"""


def _replay(spark, sf):
    """Replay over all evidence, each row with the fields of the scored row it names."""
    ev = proxy.evidence(spark, sf)
    records = evidence_records(spark, sf).join(ev.select("sequence", "explanation"), "sequence")
    scored = ev.select(
        F.lit("scored.csv").alias("artifact_path"), F.col("source_offset").alias("row_index"), F.col("occurred_at").alias("timestamp"),
        "data_format", "src", "dst", "protocol", F.col("port").cast("string").alias("port"), "label_octal",
    )
    return evidence.replay(logsrc(spark, sf), records, scored, None)


@query("replay_timeline", with_ev("""SELECT sequence, occurred_at, evidence_id, predicted_anomaly, severity, source_component, target_component, service, split_part(source_file, '/', 2) AS source_file,
    CASE WHEN explanation <> '' THEN explanation WHEN data_format = 'PCAP' THEN 'Traffic left the learned baseline of its network domain.'
      WHEN data_format = 'ARINC429' THEN 'Bus words left the learned baseline of their label.' ELSE severity || ' evidence is waiting for review.' END AS summary FROM rp""", REPLAY))
def replay_timeline(spark, sf):
    return _replay(spark, sf)["timeline"].select(
        "sequence", "occurred_at", "evidence_id", "predicted_anomaly", "severity", "source_component", "target_component", "service", "source_file", "summary"
    )


@query("replay_composition", with_ev("SELECT service AS label, count(*) AS count FROM rp GROUP BY 1", REPLAY))
def replay_composition(spark, sf):
    return _replay(spark, sf)["composition"]


@query("replay_counts", with_ev("SELECT count(*) AS count, CAST(sum(predicted_anomaly) AS BIGINT) AS anomaly_count FROM rp", REPLAY))
def replay_counts(spark, sf):
    return _replay(spark, sf)["counts"]


@query("report_lines", with_ev(f"""SELECT part, position, line FROM (
    SELECT 1 AS part, unnest([0, 1, 2, 3, 4]) AS position, unnest(['Entries: ' || count(*), 'Chain status: verified', 'Trusted: true', 'Evidence records: ' || count(*), 'Predicted anomalies: ' || CAST(sum(predicted_anomaly) AS BIGINT)]) AS line FROM ev
    UNION ALL SELECT * FROM (SELECT 2, -evidence_id, '- evidence #' || evidence_id || ' seq #' || sequence || ' severity=' || severity || ' features=' || coalesce(nullif(array_to_string(top_features, ', '), ''), 'n/a') FROM ev WHERE predicted_anomaly = 1 ORDER BY evidence_id DESC LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 3, sequence, '- seq #' || sequence || ' ' || source_type || ' offset=' || source_offset FROM ev ORDER BY occurred_at, sequence LIMIT 10))"""))
def report_lines(spark, sf):
    ev = proxy.evidence(spark, sf)
    return evidence.report_lines(aggregates.evidence_totals(ev, logsrc(spark, sf)), "verified", True, ev, ev)


@query("trimmed_evidence", with_ev(f"""SELECT sequence, evidence_id, src AS source, dst AS target, protocol, severity, anomaly_type, explanation FROM ev
    UNION ALL SELECT sequence, NULL, CASE WHEN details_operation IS NOT NULL THEN '203.0.113.45' ELSE 'error' END, CASE WHEN details_operation IS NOT NULL THEN 'SEQ #' || details_target_sequence END, event, severity, event,
      CASE WHEN event = 'tamper_attempt_blocked' THEN 'A ' || details_operation || ' attempt on sequence ' || details_target_sequence || ' was blocked.' ELSE '' END FROM sec"""))
def trimmed_evidence(spark, sf):
    pool = feeds.unify(proxy.evidence(spark, sf), proxy.security_events(spark, sf))
    return evidence.trim_evidence(pool).select("sequence", "evidence_id", "source", "target", "protocol", "severity", "anomaly_type", "explanation")


@query("sequence_dossier", with_ev(f"""SELECT e.sequence, e.severity, true AS trusted, coalesce((SELECT count(*) FROM (
      SELECT 'a' || {o.slug('source', 'src')} UNION SELECT 'b' || {o.slug('target', "dst || ':' || port")} UNION SELECT 'c')), 0) AS related_edges FROM ev e WHERE sequence IN (41, 120, 777)"""))
def sequence_dossier(spark, sf):
    """Three requested sequences with the number of edges at their event nodes."""
    ev = proxy.evidence(spark, sf)
    asked = spark.createDataFrame([(41,), (120,), (777,)], "sequence bigint")
    rows = normalized(spark, sf).filter(F.col("event_type") == "anomaly")
    members = rows.select(F.col("event_id").alias("id"), "sequence")
    found = evidence.sequence_dossier(asked, ev, graph.graph_nodes(rows), graph.graph_edges(rows), members, True)
    return found.select("sequence", "severity", "trusted", "related_edges")


@query("attack_brief", with_ev("""SELECT 'event' AS part, CAST(sequence AS VARCHAR) AS position, 'Seq #' || sequence || ' | ' || severity || ' | ' || src || ' -> ' || dst || ' (' || protocol || ')' AS line
    FROM (SELECT * FROM ev WHERE predicted_anomaly = 1 ORDER BY sequence, evidence_id LIMIT 5)"""))
def attack_brief(spark, sf):
    ev = proxy.evidence(spark, sf)
    stream = ev.select(*ev.columns, F.col("src").alias("source_component"), F.col("dst").alias("target_component"), F.col("protocol").alias("service"))
    none = spark.createDataFrame([], "source string, target string, relation string")
    return evidence.attack_brief(stream, none)


@query("attack_brief_relations", _sel("SELECT source, target, relation FROM edges ORDER BY source, target, relation LIMIT 4"))
def attack_brief_relations(spark, sf):
    g = investigation_graph(spark, sf)
    ev = proxy.evidence(spark, sf).withColumns({"source_component": F.col("src"), "target_component": F.col("dst"), "service": F.col("protocol")})
    lines = evidence.attack_brief(ev, g.edges).filter(F.col("part") == "relation")
    parts = F.split("position", ">")
    return lines.select(parts[0].alias("source"), parts[1].alias("target"), parts[2].alias("relation"))


@query("brief_summaries", with_ev("""SELECT count(*) AS total_entries, count(*) AS total_records, CAST(sum(predicted_anomaly) AS BIGINT) AS anomalies, CAST(count(*) - sum(predicted_anomaly) AS BIGINT) AS normal,
    CAST(sum(predicted_anomaly) + count(*) FILTER (source_type = 'SECURITY_EVENT') AS BIGINT) AS total_alerts, count(*) FILTER (source_type = 'SECURITY_EVENT') AS security_events_count,
    count(*) AS checked_entries, true AS chain_ok, true AS trusted FROM ev"""))
def brief_summaries(spark, sf):
    ev = proxy.evidence(spark, sf)
    checked = ev.agg(F.count(F.lit(1)).alias("checked_entries"), F.lit(True).alias("ok"))
    return evidence.brief_summaries(aggregates.evidence_totals(ev, logsrc(spark, sf)), checked, True)


@query("graph_report", _sel("""SELECT CAST(rank AS BIGINT) AS position, '- ' || label || ' | ' || domain || ' | ' || source_component || ' -> ' || target_component || ' | ' || pattern || ' | risk=' || printf('%.4f', risk) AS line FROM sel
    UNION ALL SELECT -3, 'Displayed events: ' || count(*) FROM sel UNION ALL SELECT -2, 'Graph nodes: ' || count(*) FROM nodes UNION ALL SELECT -1, 'Graph edges: ' || count(*) FROM edges"""))
def graph_report(spark, sf):
    g = investigation_graph(spark, sf)
    return evidence.graph_report_lines(g.selected, g.nodes, g.edges)


@query("decrypted_entry", with_ev("""SELECT sequence, source_file, source_type, source_offset, payload AS payload_text, sha256(payload) AS payload_sha256, 'csv_row' AS ingest_mode, 2 AS metadata_keys FROM logsrc WHERE sequence = 120"""))
def decrypted_entry(spark, sf):
    """One entry of an encrypted log opened again."""
    src = proxy.log_source(spark, sf).withColumnRenamed("order_id", "sequence")
    key = F.unhex(F.sha2(F.lit("fixture key"), 256))
    aad = crypto.associated_data(F.col("source_file"), F.col("source_type"), F.col("source_offset"), F.lit("{}"))
    sealed = crypto.encrypt_payloads(src, key, aad)
    body = F.col("metadata_json")
    stored = sealed.withColumn("metadata_json", F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(',"storage":"encrypted","record_version":3}')))
    opened = evidence.decrypted_entry(stored, 120, key, aad)
    return opened.withColumns({"ingest_mode": F.col("metadata.ingest_mode"), "metadata_keys": F.size("metadata")}).drop("metadata")


@query("evidence_summary_records", with_ev("""SELECT 'records' AS list, count(*) AS rows FROM (SELECT * FROM ev ORDER BY evidence_id DESC LIMIT 80)
    UNION ALL SELECT 'ranked_anomalies', count(*) FROM (SELECT * FROM ev WHERE predicted_anomaly = 1 LIMIT 80)
    UNION ALL SELECT 'security_events', count(*) FROM (SELECT * FROM sec LIMIT 20) UNION ALL SELECT 'severity_counts', count(DISTINCT severity) FROM ev UNION ALL SELECT 'totals', 1 FROM ev WHERE sequence = 1"""))
def evidence_summary_records(spark, sf):
    """Sizes of the lists of the summary bundle."""
    bundle = evidence.evidence_summary(logsrc(spark, sf), proxy.evidence(spark, sf), proxy.batches(spark, sf))
    names = ["records", "ranked_anomalies", "security_events", "severity_counts", "totals"]
    return feeds.unify(*(bundle[n].agg(F.lit(n).alias("list"), F.count(F.lit(1)).alias("rows")) for n in names))
