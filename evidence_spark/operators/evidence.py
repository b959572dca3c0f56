"""Evidence records, replay, reports and the data parts of question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import crypto, scalars, text
from evidence_spark.functions.scalars import filled, pick
from evidence_spark.operators import aggregates, feeds, filters, joins
from evidence_spark.operators.events import any_of
from evidence_spark.operators.ordered import global_sequence
from evidence_spark.schemas import EVIDENCE, VERDICT


def verdict(df: DataFrame) -> Column:
    """Verdict JSON of a scored row: score fields plus every context key that holds text."""
    fields = {name: F.col(name) for name in ("anomaly_score", "predicted_anomaly", "severity", "model_used") if scalars.has(df, name)}
    if "timestamp" in df.columns:
        fields["occurred_at"] = filled(F.col("timestamp").cast("string"))
    for name in policy.VERDICT_CONTEXT_KEYS:
        if scalars.has(df, name):
            fields[name] = filled(F.col(name).cast("string"))
    return F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))))


def correlation_map(log: DataFrame) -> DataFrame:
    return log.select("source_file", "source_offset", "sequence", "entry_hash", "source_type", "payload_sha256", "created_at")


def evidence_rows(joined: DataFrame, start: int = 1) -> DataFrame:
    """Evidence records of rows that carry a log mapping and a verdict."""
    parsed = joined.withColumn("_v", F.from_json("verdict_json", VERDICT))
    if "evidence_id" not in joined.columns:
        parsed = global_sequence(parsed, ["sequence"], "evidence_id", start)
    v = F.col("_v")
    return parsed.select(
        F.col("evidence_id").cast("bigint").alias("evidence_id"), "recorded_at", "source_file", "source_offset", "sequence", "entry_hash",
        pick(joined, "ai_artifact_path").alias("ai_artifact_path"),
        pick(joined, "ai_artifact_row_index", "bigint").alias("ai_artifact_row_index"),
        crypto.digest(F.col("verdict_json")).alias("ai_result_sha256"), "verdict_json",
        filled(v["model_used"]).alias("model_used"), v["anomaly_score"].alias("anomaly_score"),
        v["predicted_anomaly"].alias("predicted_anomaly"), filled(v["severity"]).alias("severity"),
    ).select(*EVIDENCE.names)


def evidence_view(evidence: DataFrame) -> DataFrame:
    """Evidence with the display fields of its verdict."""
    v = F.col("_v")
    return evidence.withColumn("_v", F.from_json("verdict_json", VERDICT)).select(
        "evidence_id", "recorded_at", F.coalesce(filled(v["occurred_at"]), F.col("recorded_at")).alias("occurred_at"),
        "source_file", "source_offset", "sequence", F.col("ai_artifact_row_index").alias("artifact_row_index"),
        "model_used", "anomaly_score", F.coalesce("predicted_anomaly", F.lit(0)).alias("predicted_anomaly"), "severity",
        F.coalesce(v["shap_top_features"], F.array().cast("array<string>")).alias("top_features"),
        text.plain_dashes(v["explanation_text"]).alias("explanation"),
        v["data_format"].alias("data_format"), v["domain"].alias("domain"), v["protocol"].alias("protocol"),
        F.coalesce(filled(v["src"]), filled(v["src_ip"])).alias("src"), F.coalesce(filled(v["dst"]), filled(v["dst_ip"])).alias("dst"),
        v["label_octal"].alias("label_octal"), v["anomaly_type"].alias("anomaly_type"),
        F.coalesce(filled(v["port"]), filled(v["dst_port"])).alias("port"),
    )


def replay_components(df: DataFrame) -> tuple[Column, Column, Column]:
    """Source, target and service of a replay row, from the scored row it points to."""
    kind = F.upper(F.coalesce(any_of(df, "data_format"), F.lit("LOG")))
    source = any_of(df, "src", "src_ip", "source_ip", "source_component")
    target = any_of(df, "dst", "dst_ip", "destination_ip", "target_component")
    service = F.coalesce(any_of(df, "protocol", "service", "port", "dst_port"), kind)
    stem = filled(F.regexp_replace(scalars.base_name(pick(df, "source_file")), r"\.[^.]*$", ""))
    label = F.coalesce(any_of(df, "label_octal", "src"), F.lit("unknown label"))
    packet, word, known = kind == policy.PACKET_FORMAT, kind == policy.WORD_FORMAT, source.isNotNull() | target.isNotNull()
    return (
        F.when(word, "ARINC 429 bus").when(packet, F.coalesce(source, F.lit("unknown source")))
        .when(known, F.coalesce(source, stem, F.lit("unknown source"))).otherwise(F.coalesce(stem, F.lit("log source"))),
        F.when(word, F.concat(F.lit("label "), label)).when(packet | known, F.coalesce(target, F.lit("unknown target"))).otherwise("evidence log"),
        F.when(word, "avionics word").when(packet | known, service).otherwise(kind),
    )


def event_summary(data_format: Column, severity: Column, explanation: Column) -> Column:
    """The explanation, or a sentence that says what kind of baseline was left."""
    return F.coalesce(
        filled(explanation),
        F.when(data_format == policy.PACKET_FORMAT, "Traffic left the learned baseline of its network domain.")
        .when(data_format == policy.WORD_FORMAT, "Bus words left the learned baseline of their label.")
        .otherwise(F.concat(F.coalesce(filled(severity), F.lit("Anomalous")), F.lit(" evidence is waiting for review."))),
    )


ARTIFACT_FIELDS = ["timestamp", "data_format", "src", "dst", "protocol", "port", "label_octal"]


def replay(log: DataFrame, evidence: DataFrame, scored: DataFrame | None = None, n: int | None = None) -> dict[str, DataFrame]:
    """Replay bundle. ``n`` limits the rows of the view as a page size; None keeps all."""
    base = joins.replay_base(log, evidence)
    if n is not None:
        base = base.orderBy("sequence", "evidence_id").limit(n)
    if scored is not None:
        base = joins.attach_artifact(base, scored, ARTIFACT_FIELDS)
        rows = base.select(*(c for c in base.columns if c not in ARTIFACT_FIELDS and not c.startswith("artifact_")), *(F.col(f"artifact_{c}").alias(c) for c in ARTIFACT_FIELDS))
    else:
        rows = base
    source, target, service = replay_components(rows)
    hit = F.coalesce("predicted_anomaly", F.lit(0))
    severity = F.coalesce(filled(F.col("severity")), F.when(hit == 1, "HIGH").otherwise("NORMAL"))
    said = text.plain_dashes(pick(rows, "explanation"))
    stream = rows.select(
        "sequence", F.coalesce(filled(pick(rows, "timestamp")), F.col("created_at")).alias("occurred_at"), F.col("created_at").alias("recorded_at"),
        "source_type", scalars.base_name(F.col("source_file")).alias("source_file"), "source_offset", "evidence_id",
        hit.alias("predicted_anomaly"), severity.alias("severity"), "anomaly_score", said.alias("explanation"),
        source.alias("source_component"), target.alias("target_component"), service.alias("service"),
        event_summary(pick(rows, "data_format"), severity, said).alias("summary"),
    )
    return {
        "timeline": feeds.timeline(stream),
        "composition": aggregates.composition(stream, F.coalesce(filled(F.col("service")), filled(F.col("source_type")))),
        "counts": stream.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("predicted_anomaly") == 1).alias("anomaly_count")),
    }


def evidence_summary(log: DataFrame, evidence: DataFrame, checkpoints: DataFrame, n: int | None = 80, security_n: int | None = 20) -> dict[str, DataFrame]:
    return {
        "totals": aggregates.evidence_totals(evidence, log),
        "severity_counts": aggregates.severity_counts(evidence),
        "latest_checkpoint": feeds.latest_checkpoint(checkpoints),
        "records": feeds.recent_evidence(evidence, n),
        "score_trace": feeds.score_trace(evidence, n and 2 * n),
        "ranked_anomalies": feeds.ranked_anomalies(evidence, n),
        "security_events": filters.page(filters.security_only(log).orderBy(F.desc("sequence")), security_n),
    }


def report_lines(totals: DataFrame, status: str, trusted: bool, records: DataFrame, timeline: DataFrame, n: int = 10) -> DataFrame:
    """Text report as (part, position, line): totals, newest anomalies, replay head."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    head = totals.select(F.explode(F.array(
        F.struct(F.lit(0).alias("position"), F.concat(F.lit("Entries: "), s("total_entries")).alias("line")),
        F.struct(F.lit(1).alias("position"), F.lit(f"Chain status: {status}").alias("line")),
        F.struct(F.lit(2).alias("position"), F.lit(f"Trusted: {str(trusted).lower()}").alias("line")),
        F.struct(F.lit(3).alias("position"), F.concat(F.lit("Evidence records: "), s("total_records")).alias("line")),
        F.struct(F.lit(4).alias("position"), F.concat(F.lit("Predicted anomalies: "), s("anomalies")).alias("line")),
    )).alias("r")).select(F.lit(1).alias("part"), F.col("r.position").cast("bigint").alias("position"), "r.line")
    newest = filters.flagged(records).orderBy(F.desc("evidence_id")).limit(n)
    latest = newest.select(
        F.lit(2).alias("part"), (-F.col("evidence_id")).alias("position"),
        F.concat(F.lit("- evidence #"), s("evidence_id"), F.lit(" seq #"), s("sequence"), F.lit(" severity="), s("severity"),
                 F.lit(" features="), F.coalesce(filled(F.array_join("top_features", ", ")), F.lit("n/a"))).alias("line"),
    )
    replayed = timeline.orderBy("occurred_at", "sequence").limit(n).select(
        F.lit(3).alias("part"), F.col("sequence").alias("position"),
        F.concat(F.lit("- seq #"), s("sequence"), F.lit(" "), s("source_type"), F.lit(" offset="), s("source_offset")).alias("line"),
    )
    return feeds.unify(head, latest, replayed).orderBy("part", "position")


def graph_report_lines(selected: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Summary of a graph as (position, line); one line per selected event."""
    counts = [f"Displayed events: {selected.count()}", f"Graph nodes: {nodes.count()}", f"Graph edges: {edges.count()}"]
    head = selected.sparkSession.createDataFrame(list(enumerate(counts, start=-len(counts))), "position bigint, line string")
    body = selected.select(
        F.col("rank").cast("bigint").alias("position"),
        F.concat(F.lit("- "), "label", F.lit(" | "), "domain", F.lit(" | "), "source_component", F.lit(" -> "), "target_component",
                 F.lit(" | "), "pattern", F.lit(" | risk="), F.format_number("risk", 4)).alias("line"),
    )
    return head.unionByName(body)


def trim_evidence(df: DataFrame, max_chars: int | None = None, max_features: int | None = None) -> DataFrame:
    """Evidence record in the short shape used as context, fallbacks applied; texts and
    feature lists are whole unless a number is given."""
    name, operation = any_of(df, "event", "event_name"), any_of(df, "details_operation", "operation")
    about = F.coalesce(any_of(df, "details_target_sequence"), any_of(df, "target_sequence"))
    tamper = F.coalesce(name.isin(policy.BLOCKED_EVENT_NAMES), F.lit(False)) | (operation.isNotNull() & about.isNotNull())
    attacker = F.when(tamper, F.coalesce(any_of(df, "details_attacker_ip"), F.lit(policy.DEFAULT_ATTACKER_ADDRESS)))
    stem = filled(F.regexp_replace(scalars.base_name(pick(df, "source_file")), r"\.[^.]*$", ""))
    blocked = F.when(name == "tamper_attempt_blocked", F.concat(
        F.lit("A "), F.coalesce(operation, F.lit("mutation")), F.lit(" attempt on sequence "), F.coalesce(about, F.lit("unknown")), F.lit(" was blocked.")))
    said = F.coalesce(filled(text.clean_ws(any_of(df, "explanation", "summary"))), blocked, F.lit(""))
    features = F.coalesce("top_features", F.array().cast("array<string>")) if scalars.has(df, "top_features") else F.array().cast("array<string>")
    return df.select(
        pick(df, "sequence", "bigint").alias("sequence"), pick(df, "evidence_id", "bigint").alias("evidence_id"),
        any_of(df, "occurred_at", "recorded_at", "timestamp").alias("occurred_at"), pick(df, "source_file").alias("source_file"),
        F.coalesce(any_of(df, "source_component", "attacker_ip"), attacker, any_of(df, "src", "source"), stem, any_of(df, "source_type")).alias("source"),
        F.coalesce(any_of(df, "target_component", "dst", "target"), F.concat(F.lit("SEQ #"), about)).alias("target"),
        F.coalesce(any_of(df, "protocol", "service", "data_format"), name).alias("protocol"), pick(df, "domain").alias("domain"),
        pick(df, "severity").alias("severity"), pick(df, "anomaly_score", "double").alias("anomaly_score"),
        pick(df, "predicted_anomaly", "bigint").alias("predicted_anomaly"), F.coalesce(any_of(df, "anomaly_type"), name).alias("anomaly_type"),
        (features if max_features is None else F.slice(features, 1, max_features)).alias("top_features"),
        (said if max_chars is None else F.substring(said, 1, max_chars)).alias("explanation"),
    )


def related_counts(pool: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Number of graph edges that touch the nodes of each sequence."""
    touched = members.select("id", "sequence")
    out = edges.join(touched, edges.source == touched.id).select("sequence", "source", "target", "relation")
    into = edges.join(touched, edges.target == touched.id).select("sequence", "source", "target", "relation")
    return out.unionByName(into).distinct().groupBy("sequence").agg(F.count(F.lit(1)).alias("related_edges"))


def sequence_dossier(sequences: DataFrame, pool: DataFrame, nodes: DataFrame, edges: DataFrame, event_nodes: DataFrame, trusted: bool) -> DataFrame:
    """Requested sequences with their record, the edges around their event node and the
    trust state of the log."""
    asked = joins.records_for(sequences, pool)
    counts = related_counts(asked, nodes, edges, event_nodes.join(sequences, "sequence", "left_semi"))
    return asked.join(counts, "sequence", "left").withColumns(
        {"related_edges": F.coalesce("related_edges", F.lit(0)), "trusted": F.lit(bool(trusted))}
    )


def attack_brief(stream: DataFrame, edges: DataFrame, n: int = 5, relations: int = 4) -> DataFrame:
    """First flagged events of the stream and first relations, as (part, position, line)."""
    flagged = filters.flagged(stream).orderBy("sequence", "evidence_id").limit(n)
    s = lambda c, other: F.coalesce(filled(F.col(c).cast("string")), F.lit(other))
    events = flagged.select(
        F.lit("event").alias("part"), F.col("sequence").cast("string").alias("position"),
        F.concat(F.lit("Seq #"), F.col("sequence").cast("string"), F.lit(" | "), F.upper(s("severity", "unknown")), F.lit(" | "),
                 s("source_component", "unknown"), F.lit(" -> "), s("target_component", "unknown"), F.lit(" ("), s("service", "event"), F.lit(")")).alias("line"),
    )
    first = edges.orderBy("source", "target", "relation").limit(relations).select(
        F.lit("relation").alias("part"), F.concat_ws(">", "source", "target", "relation").alias("position"),
        F.concat("source", F.lit(" -> "), "target", F.lit(": "), "relation").alias("line"),
    )
    return events.unionByName(first)


def brief_summaries(totals: DataFrame, checked: DataFrame, trusted: bool) -> DataFrame:
    """Status and anomaly numbers in one row; both inputs are one-row tables."""
    row = checked.first()
    return totals.select(
        "total_entries", "total_records", "anomalies", "normal", "total_alerts", "security_events_count",
        F.lit(row["checked_entries"]).alias("checked_entries"), F.lit(bool(row["ok"])).alias("chain_ok"), F.lit(bool(trusted)).alias("trusted"),
    )


def snapshot(bundle: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Store the tables of an investigation below one id, one folder per table."""
    for name, df in bundle.items():
        df.write.mode("errorifexists").parquet(f"{path}/snapshot_id={snapshot_id}/{name}")


def security_event(df: DataFrame, name: Column, severity: Column, detected_at: Column, details: Column) -> DataFrame:
    """Structured event rows as raw log events; ``details`` is JSON text."""
    body = F.concat(
        F.lit('{"details":'), details, F.lit(","),
        F.substring(F.to_json(F.struct(detected_at.alias("detected_at"), name.alias("event"), severity.alias("severity"))), 2, 1_000_000_000),
    )
    meta = F.to_json(F.struct(name.alias("event_name"), F.lit("security_event").alias("ingest_mode"), severity.alias("severity")))
    return df.select(
        detected_at.alias("created_at"), F.lit("security_monitor").alias("source_file"), F.lit("SECURITY_EVENT").alias("source_type"),
        F.col("source_offset"), meta.alias("metadata_json"), body.cast("binary").alias("payload"),
    )


def decrypted_entry(log: DataFrame, sequence: int, key: Column, aad: Column) -> DataFrame:
    """One entry opened for display, with its metadata free of reserved keys."""
    opened = crypto.decrypt_payloads(filters.entry(log, sequence), key, aad)
    meta = F.from_json("metadata_json", "map<string,string>")
    return opened.select(
        "sequence", "source_file", "source_type", "source_offset", crypto.payload_text(F.col("plaintext")).alias("payload_text"),
        crypto.digest(F.col("plaintext")).alias("payload_sha256"), crypto.user_metadata(meta).alias("metadata"),
    )
