"""Top-k views, unions and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import crypto, scalars
from evidence_spark.functions.scalars import filled, pick
from evidence_spark.operators.filters import flagged, page


# --- top-k ------------------------------------------------------------------------------------

def recent_entries(log: DataFrame, n: int | None = 25) -> DataFrame:
    meta = F.col("metadata_json")
    top = page(log.orderBy(F.desc("sequence")), n)
    return top.select(
        "sequence", "created_at", "source_file", "source_type", "source_offset", "payload_sha256",
        *(c for c in ("previous_hash", "entry_hash", "rsa_key_id") if c in log.columns),
        F.get_json_object(meta, "$.record_version").alias("record_version"),
        F.get_json_object(meta, "$.ingest_mode").alias("ingest_mode"),
        F.get_json_object(meta, "$.storage").alias("storage"),
    )


def sequence_entries(log: DataFrame, n: int | None = None) -> DataFrame:
    mode = F.coalesce(F.get_json_object("metadata_json", "$.ingest_mode"), F.lit(""))
    return page(log.orderBy(F.desc("sequence")), n).select(
        "sequence", "created_at", "source_file", "source_type", "source_offset",
        mode.alias("ingest_mode"), scalars.offset_unit(mode, F.col("source_type")).alias("offset_label"),
    )


def ranked_anomalies(evidence: DataFrame, n: int | None = None) -> DataFrame:
    return page(flagged(evidence).orderBy("anomaly_score", F.desc("evidence_id")), n)


def recent_evidence(evidence: DataFrame, n: int | None = None) -> DataFrame:
    return page(evidence.orderBy(F.desc("evidence_id")), n)


def score_trace(evidence: DataFrame, recent_n: int | None = 160, flagged_n: int | None = None) -> DataFrame:
    """Recent records together with the oldest flagged ones, each once, by time."""
    recent = recent_evidence(evidence, recent_n)
    oldest = page(flagged(evidence).orderBy("evidence_id"), flagged_n)
    return recent.unionByName(oldest).dropDuplicates(["evidence_id"]).orderBy(scalars.event_time(evidence), "evidence_id")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    row = F.struct(*checkpoints.columns)
    return checkpoints.agg(F.max_by(row, F.col("checkpoint_id")).alias("_row")).filter(F.col("_row").isNotNull()).select("_row.*")


def security_events_view(log: DataFrame, n: int | None = 8, key: Column | None = None, aad: Column | None = None) -> DataFrame:
    """Newest security events; fields come from the payload, then from the metadata. With a
    key, payloads are encrypted and are opened first; one that does not open shows metadata."""
    if key is not None:
        log = crypto.decrypt_payloads(log, key, aad).withColumn("payload", F.col("plaintext"))
    body, meta = F.col("payload").cast("string"), F.col("metadata_json")
    field = lambda c, p: filled(F.get_json_object(c, p))
    top = page(log.filter(F.col("source_type") == "SECURITY_EVENT").orderBy(F.desc("sequence")), n)
    return top.select(
        "sequence", "created_at", "source_file", "source_offset",
        F.coalesce(field(body, "$.event"), field(meta, "$.event_name"), F.lit("security_event")).alias("event"),
        F.coalesce(field(body, "$.severity"), field(meta, "$.severity"), F.lit("INFO")).alias("severity"),
        F.coalesce(F.get_json_object(body, "$.details"), F.lit("{}")).alias("details_json"),
        F.coalesce(
            field(body, "$.attacker_ip"), field(body, "$.details.attacker_ip"), F.lit(policy.DEFAULT_ATTACKER_ADDRESS)
        ).alias("attacker_ip"),
    )


def select_top(events: DataFrame, n: int | None = 10) -> DataFrame:
    """Top events by risk, size of score and time; change attempts always stay. The
    ``rank`` column is their order by time, then falling risk."""
    if n:
        keys = [F.desc("risk"), F.desc(F.abs(F.coalesce("anomaly_score", F.lit(0.0)))), F.desc("event_us"), "event_id"]
        top = events.orderBy(*keys).limit(n)
        pinned = events.filter(F.col("event_type") == "mutation_attempt")
        # an id may repeat (an attempt and the security event about it): the riskiest row
        # stays, then the earliest, then the one whose fields come first
        row = F.struct(*events.columns)
        order = F.struct(-F.col("risk"), F.col("event_us"), F.to_json(row))
        events = top.unionByName(pinned).groupBy("event_id").agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return events


def top_evidence(pool: DataFrame, n: int = 10) -> DataFrame:
    """Flagged first, then severity, then score."""
    unflagged = F.when(F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1, 0).otherwise(1)
    severity = scalars.lookup(F.upper(scalars.text_of(F.col("severity"))), policy.PRIORITY_RANK, 4)
    return pool.orderBy(unflagged, severity, F.coalesce("anomaly_score", F.lit(0.0)), "sequence", "evidence_id").limit(n)


def anchor_history(anchors: DataFrame, n: int | None = 12) -> DataFrame:
    """The last anchors in ledger order."""
    cols = ["position", "created_at", "sequence", "entry_count", "anchor_hash", "previous_anchor_hash"]
    return page(anchors.select(*cols).orderBy(F.desc("position")), n).orderBy("position")


def recent_documents(docs: DataFrame, n: int | None = 12) -> DataFrame:
    return page(docs.orderBy(F.desc("uploaded_at"), "doc_id"), n)


def order_sources(sources: DataFrame) -> DataFrame:
    kind = scalars.source_kind(F.col("source_type"), F.col("source_file"))
    name = scalars.base_name(F.col("source_file"))
    ranked = sources.withColumns({"kind": kind, "name": name})
    return ranked.orderBy(scalars.source_rank(F.col("kind")), F.desc("last_seen"), "name")


def timeline(df: DataFrame) -> DataFrame:
    return df.orderBy(scalars.event_time(df), "sequence", "evidence_id")


def top_nodes(nodes: DataFrame, n: int = 6) -> DataFrame:
    return nodes.orderBy(F.desc("risk"), "id").limit(n)


# --- sets -------------------------------------------------------------------------------------------

def unify(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


FEED_COLUMNS = [
    "kind", "kind_label", "recorded_at", "sequence", "record_id", "activity", "source_file",
    "source_type", "classification", "context", "batch_key",
]


def log_activity(log: DataFrame) -> DataFrame:
    meta = F.col("metadata_json")
    security = F.col("source_type") == "SECURITY_EVENT"
    name = F.coalesce(filled(F.get_json_object(meta, "$.event_name")), F.lit("security_event"))
    severity = F.coalesce(filled(F.get_json_object(meta, "$.severity")), F.lit("INFO"))
    seq = F.col("sequence").cast("string")
    return log.select(
        F.when(security, "security_event").otherwise("raw_log").alias("kind"),
        F.lit("Log").alias("kind_label"),
        F.col("created_at").alias("recorded_at"),
        "sequence",
        F.concat(F.lit("seq-"), seq).alias("record_id"),
        F.when(security, "Security event appended").otherwise("Raw log appended").alias("activity"),
        "source_file",
        "source_type",
        F.when(security & scalars.is_critical(name, severity), "Critical").otherwise("Normal").alias("classification"),
        F.lit("Sealed append").alias("context"),
        F.concat_ws(":", F.lit("log"), "source_type", "source_file").alias("batch_key"),
    )


def evidence_activity(evidence: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("predicted_anomaly"), F.lit(0)) == 1
    severity = F.coalesce(filled(F.col("severity")), F.lit("normal"))
    klass = F.when(hit | F.upper(severity).isin("CRITICAL", "HIGH"), "Critical").otherwise("Normal")
    return evidence.select(
        F.lit("ai_evidence").alias("kind"),
        F.lit("AI").alias("kind_label"),
        "recorded_at",
        "sequence",
        F.concat(F.lit("ai-"), F.col("evidence_id").cast("string")).alias("record_id"),
        F.lit("AI evidence stored").alias("activity"),
        "source_file",
        F.lit("AI_EVIDENCE").alias("source_type"),
        klass.alias("classification"),
        F.concat(F.when(hit, "Flagged anomaly").otherwise("Normal verdict"), F.lit(" / "), scalars.title_case(severity)).alias("context"),
        F.concat_ws(":", F.lit("ai"), klass, "source_file").alias("batch_key"),
    )


def checkpoint_activity(checkpoints: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return checkpoints.select(
        F.lit("ai_checkpoint").alias("kind"),
        F.lit("AI").alias("kind_label"),
        F.col("created_at").alias("recorded_at"),
        F.col("last_evidence_id").alias("sequence"),
        F.concat(F.lit("ai-checkpoint-"), text("checkpoint_id")).alias("record_id"),
        F.lit("AI checkpoint stored").alias("activity"),
        F.lit("AI evidence ledger").alias("source_file"),
        F.lit("AI_CHECKPOINT").alias("source_type"),
        F.lit("Normal").alias("classification"),
        F.concat(text("batch_size"), F.lit(" records, #"), text("first_evidence_id"), F.lit(" to #"), text("last_evidence_id")).alias("context"),
        F.concat(F.lit("ai_checkpoint:"), F.col("checkpoint_type")).alias("batch_key"),
    )


def attempt_address() -> Column:
    field = lambda p: filled(F.get_json_object("details_json", p))
    return F.coalesce(field("$.attacker_ip"), field("$.actor_ip"), F.lit(policy.DEFAULT_ATTACKER_ADDRESS))


def attempt_activity(attempts: DataFrame) -> DataFrame:
    field = lambda p: filled(F.get_json_object("details_json", p))
    name = F.coalesce(field("$.table"), filled(F.col("sqlite_action")), F.lit("protected table"))
    operation = F.coalesce(filled(F.col("operation")), F.lit("mutation"))
    return attempts.select(
        F.lit("mutation_attempt").alias("kind"),
        F.lit("Attempt").alias("kind_label"),
        F.col("detected_at").alias("recorded_at"),
        F.col("target_sequence").alias("sequence"),
        F.concat(F.lit("attempt-"), F.col("attempt_id").cast("string")).alias("record_id"),
        F.concat(scalars.title_case(operation), F.lit(" attempt blocked")).alias("activity"),
        F.coalesce(field("$.old_source_file"), name).alias("source_file"),
        F.lit("MUTATION_ATTEMPT").alias("source_type"),
        F.lit("Critical").alias("classification"),
        F.concat(F.lit("Protected table: "), name).alias("context"),
        F.concat_ws(":", F.lit("attempt"), "operation", name).alias("batch_key"),
    )


def activity_feed(log: DataFrame, evidence: DataFrame, checkpoints: DataFrame, attempts: DataFrame, n: int | None = None) -> DataFrame:
    """Four tables in one shape, newest first; ``n`` keeps the newest rows of each."""
    newest = lambda df, key: df if n is None else df.orderBy(F.desc(key)).limit(n)
    parts = [
        log_activity(newest(log, "sequence")),
        evidence_activity(newest(evidence, "evidence_id")),
        checkpoint_activity(newest(checkpoints, "checkpoint_id")),
        attempt_activity(newest(attempts, "attempt_id")),
    ]
    return unify(*parts).select(*FEED_COLUMNS).orderBy(F.desc("recorded_at"), "record_id")


def attempt_events(attempts: DataFrame) -> DataFrame:
    """Attempts as graph input events."""
    return attempts.select(
        F.lit("mutation_attempt").alias("kind"),
        F.lit("mutation_attempt").alias("event_type"),
        F.col("target_sequence").alias("sequence"),
        "target_sequence",
        "attempt_id",
        "operation",
        F.col("detected_at").alias("recorded_at"),
        "occurred_us",
        F.concat(scalars.title_case(F.col("operation")), F.lit(" attempt blocked")).alias("activity"),
        attempt_address().alias("attacker_ip"),
        F.concat(F.lit("SEQ #"), F.col("target_sequence").cast("string")).alias("target_component"),
    )


def provenance_events(evidence: DataFrame, security: DataFrame, attempts: DataFrame, n: int | None = None, security_n: int | None = None, attempts_n: int | None = None) -> DataFrame:
    """Ranked anomalies, newest security events and the attempts those do not report; all
    of each without a number."""
    from evidence_spark.operators.joins import new_attempts

    ranked = ranked_anomalies(evidence, n)
    recent = page(security.orderBy(F.desc("sequence")), security_n).withColumn("event_type", F.lit("security_event"))
    fresh = new_attempts(page(attempts.orderBy(F.desc("attempt_id")), attempts_n), recent)
    return unify(ranked, recent, attempt_events(fresh))


def audit_entries(activity: DataFrame, security: DataFrame) -> DataFrame:
    """Audit rows of both lists, one per lane and record; the activity feed wins."""
    both = unify(activity.withColumn("_list", F.lit(0)), security.withColumn("_list", F.lit(1)))
    text = F.lower(F.concat_ws(" ", *(filled(pick(both, c)) for c in (
        "kind", "activity", "event", "source_type", "classification", "severity", "context", "operation", "details_operation"))))
    event = pick(both, "event")
    mutation = (
        (pick(both, "kind") == "mutation_attempt")
        | text.contains("mutation") | text.contains("tamper_attempt")
        | text.contains("update attempt") | text.contains("delete attempt")
        | (pick(both, "details_operation").isNotNull() & pick(both, "details_target_sequence").isNotNull())
    )
    mutation = F.coalesce(mutation, F.lit(False))
    recovery = (
        text.contains("restore") | text.contains("recovery") | text.contains("ledger") | text.contains("tamper")
        | (pick(both, "kind") == "security_event") | (pick(both, "source_type") == "SECURITY_EVENT") | (F.col("_list") == 1)
    )
    sequence = F.coalesce(*(F.nullif(pick(both, c, "bigint"), F.lit(0)) for c in ("sequence", "target_sequence", "details_target_sequence", "evidence_id", "attempt_id")))
    record = F.coalesce(
        filled(pick(both, "record_id")),
        F.when(mutation, filled(pick(both, "attempt_id"))).otherwise(F.concat(F.lit("seq-"), sequence.cast("string"))),
        F.concat_ws("-", event, scalars.audit_time(both)),
    )
    lane = F.when(mutation, "mutation").otherwise("recovery")
    status = (
        F.when(F.coalesce(pick(both, "synced_to_chain", "boolean"), F.lit(False)) | text.contains("blocked"), "Blocked")
        .when(text.contains("restore"), "Recovery")
        .when(text.contains("tamper") | text.contains("corrupt"), "Detected")
        .otherwise(scalars.title_case(F.coalesce(filled(pick(both, "classification")), filled(pick(both, "severity")), F.lit("Recorded"))))
    )
    bucket = scalars.severity_bucket(F.coalesce(filled(pick(both, "severity")), filled(pick(both, "classification"))))
    row = F.struct(
        sequence.alias("sequence"),
        scalars.audit_time(both).alias("occurred_at"),
        status.alias("audit_status"),
        F.when(mutation | (bucket == "high"), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(mutation, 1).otherwise(0).alias("predicted_anomaly"),
    )
    kept = both.filter(mutation | F.coalesce(recovery, F.lit(False))).select(
        lane.alias("lane"), record.alias("record_id"), row.alias("_row"), F.struct("_list", scalars.audit_time(both).alias("_t"), sequence.alias("_s")).alias("_at")
    )
    return kept.groupBy("lane", "record_id").agg(F.min_by("_row", "_at").alias("_row")).select("lane", "record_id", "_row.*")


def evidence_pool(*pools: DataFrame) -> DataFrame:
    """Records of several lists, once per (sequence, evidence id, file, offset); the
    earliest list wins."""
    key = ["sequence", "evidence_id", "source_file", "source_offset"]
    tagged = [p.withColumn("_list", F.lit(i)) for i, p in enumerate(pools)]
    both = unify(*tagged)
    rest = [c for c in both.columns if c not in (*key, "_list")]
    kept = both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("_list")).alias("_row"))
    return kept.select(*key, "_row.*")


def evidence_stream(ai: DataFrame, audit: DataFrame) -> DataFrame:
    both = unify(ai, audit)
    at = F.coalesce(pick(both, "sequence", "bigint"), pick(both, "evidence_id", "bigint"), pick(both, "source_offset", "bigint"), F.lit(0))
    return both.orderBy(at)


def chain_growth(entries: DataFrame, sources: DataFrame, anchors: DataFrame, head: DataFrame, n: int | None = None) -> DataFrame:
    """Rows that show how the log grew, newest first: the entries when there are any,
    otherwise sources, anchors and head."""
    if not entries.isEmpty():
        kind = scalars.source_kind(F.col("source_type"), F.col("source_file"))
        rows = entries.select(
            F.concat(F.lit("entry-"), F.col("sequence").cast("string")).alias("key"), kind.alias("type"),
            F.concat(F.lit("Sequence #"), F.col("sequence").cast("string")).alias("title"),
            F.concat_ws(" ", "offset_label", F.col("source_offset").cast("string")).alias("position"),
            F.col("created_at").alias("time"), F.col("sequence").cast("double").alias("rank"),
        )
    else:
        text = lambda c: F.col(c).cast("string")
        rows = unify(
            sources.select(
                F.concat_ws("-", F.lit("source"), "source_file", "source_type", text("first_sequence")).alias("key"),
                scalars.source_kind(F.col("source_type"), F.col("source_file")).alias("type"),
                scalars.base_name(F.col("source_file")).alias("title"),
                F.concat(F.lit("Seq "), text("first_sequence"), F.lit(" to "), text("last_sequence")).alias("position"),
                F.col("last_seen").alias("time"), F.col("first_sequence").cast("double").alias("rank"),
            ),
            anchors.select(
                F.concat(F.lit("anchor-"), text("position")).alias("key"), F.lit("Anchor").alias("type"),
                F.concat(F.lit("Signed Anchor "), text("position")).alias("title"),
                F.concat(F.lit("Seq "), text("sequence")).alias("position"),
                F.col("created_at").alias("time"), F.col("sequence").cast("double").alias("rank"),
            ),
            head.select(
                F.concat(F.lit("head-"), text("sequence")).alias("key"), F.lit("Head").alias("type"),
                F.lit("Current Chain Head").alias("title"), F.concat(F.lit("Seq "), text("sequence")).alias("position"),
                F.lit(None).cast("string").alias("time"), (F.col("sequence") + F.lit(0.1)).alias("rank"),
            ),
        )
    return page(rows.filter(F.col("rank") > 0).orderBy(F.desc("rank"), F.desc("time")), n)
