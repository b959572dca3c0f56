"""Sealing, verification, checkpoints and recovery over the whole evidence log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import crypto
from evidence_spark.operators import integrity
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.registry import query

ZERO = "repeat('0', 64)"
KEY = "test-key"

SEALED = f"""
src AS (SELECT *, row_number() OVER (ORDER BY sequence) AS n, (row_number() OVER (ORDER BY sequence) - 1) // 64 AS segment_id,
   sha256(payload) AS payload_sha256,
   '{{"created_at":"' || created_at || '","metadata":' || metadata_json || ',"payload_sha256":"' || sha256(payload) || '","previous_hash":"' AS head,
   '","record_version":3,"rsa_key_id":"test-key","source_file":"' || source_file || '","source_offset":' || source_offset || ',"source_type":"' || source_type || '"}}' AS tail
   FROM logsrc),
chain AS (
   SELECT n, segment_id, CASE WHEN segment_id = 0 THEN {ZERO} ELSE sha256({ZERO} || ':' || segment_id) END AS previous_hash,
          sha256(head || CASE WHEN segment_id = 0 THEN {ZERO} ELSE sha256({ZERO} || ':' || segment_id) END || tail) AS entry_hash
   FROM src WHERE (n - 1) % 64 = 0
   UNION ALL
   SELECT s.n, s.segment_id, c.entry_hash, sha256(s.head || c.entry_hash || s.tail) FROM chain c JOIN src s ON s.n = c.n + 1 AND s.segment_id = c.segment_id),
sealed AS (SELECT s.n AS sequence, s.segment_id, s.payload, s.payload_sha256, c.previous_hash, c.entry_hash, s.head, s.tail,
   s.head || c.previous_hash || s.tail AS material FROM src s JOIN chain c ON s.n = c.n)
"""

EDITED = """
edited AS (
   SELECT CASE sequence WHEN 90 THEN 91 WHEN 91 THEN 90 ELSE sequence END AS sequence, segment_id,
          CASE WHEN sequence = 41 THEN 'tampered' ELSE payload END AS payload, payload_sha256, previous_hash, entry_hash, head, tail, material
   FROM sealed WHERE sequence <> 17
   UNION ALL SELECT sequence, segment_id, payload, payload_sha256, previous_hash, entry_hash, head, tail, material FROM sealed WHERE sequence = 120)
"""


def edited(rows):
    """The planted edits: 17 deleted, 41 rewritten, 90 and 91 swapped, 120 copied."""
    seq = F.col("sequence")
    kept = rows.filter(seq != 17).withColumn("payload", F.when(seq == 41, F.lit("tampered").cast("binary")).otherwise(F.col("payload")))
    swapped = kept.withColumn("sequence", F.when(seq == 90, 91).when(seq == 91, 90).otherwise(seq).cast("bigint"))
    return swapped.unionByName(rows.filter(seq == 120))


@query("seal_log", with_ev("SELECT sequence, segment_id, payload_sha256, previous_hash, entry_hash FROM sealed", SEALED, recursive=True))
def seal_log(spark, sf):
    return proxy.sealed_log(spark, sf).rows.select("sequence", "segment_id", "payload_sha256", "previous_hash", "entry_hash")


@query("seal_head", with_ev("SELECT hs[1] AS head_hash FROM fold ORDER BY step DESC LIMIT 1", SEALED, f"""
heads AS (SELECT segment_id, arg_max(entry_hash, sequence) AS h FROM sealed GROUP BY segment_id),
fold AS (SELECT 0 AS step, list(h ORDER BY segment_id) AS hs FROM heads
  UNION ALL SELECT step + 1, list_transform(range(0, (len(hs) + 63) // 64), lambda g: list_reduce(list_concat([{ZERO}], hs[g * 64 + 1 : g * 64 + 64]), lambda a, x: sha256(a || x))) FROM fold WHERE len(hs) > 1)""", recursive=True))
def seal_head(spark, sf):
    return proxy.sealed_log(spark, sf).head


CHECKS = f"""
v AS (SELECT *, CASE WHEN lag(segment_id) OVER w = segment_id THEN lag(entry_hash) OVER w
        ELSE CASE WHEN segment_id = 0 THEN {ZERO} ELSE sha256({ZERO} || ':' || segment_id) END END AS expected,
        replace(head, payload_sha256, sha256(payload)) || previous_hash || tail AS now_material
      FROM edited WINDOW w AS (ORDER BY sequence, previous_hash, entry_hash)),
checked AS (SELECT sequence, previous_hash = expected AS previous_hash_matches, payload_sha256 = sha256(payload) AS payload_hash_matches,
        material = now_material AS entry_material_matches, entry_hash = sha256(now_material) AS entry_hash_matches, true AS key_id_matches FROM v)
"""


@query("verify_chain", with_ev("""SELECT * FROM checked WHERE NOT (previous_hash_matches AND payload_hash_matches AND entry_material_matches AND entry_hash_matches)""",
                               SEALED, EDITED, CHECKS, recursive=True))
def verify_chain(spark, sf):
    """Rows that fail after the planted edits, with every check."""
    checked = integrity.verify_rows(edited(proxy.sealed_log(spark, sf).rows), KEY, keep=[])
    return checked.filter(integrity.row_failed()).select(
        "sequence", "previous_hash_matches", "payload_hash_matches", "entry_material_matches", "entry_hash_matches", "key_id_matches"
    )


@query("verify_summary", with_ev("""SELECT false AS ok, count(*) FILTER (sequence <= (SELECT min(sequence) FROM checked WHERE NOT (previous_hash_matches AND payload_hash_matches AND entry_hash_matches))) AS checked_entries,
    (SELECT min(sequence) FROM checked WHERE NOT (previous_hash_matches AND payload_hash_matches AND entry_hash_matches)) AS first_failure, false AS segments_ok FROM checked""",
                                 SEALED, EDITED, CHECKS, recursive=True))
def verify_summary(spark, sf):
    sealed = proxy.sealed_log(spark, sf)
    _, summary = integrity.verify_chain(edited(sealed.rows), KEY, sealed.segments, keep=[])
    return summary.drop("head_hash")


@query("verify_intact", with_ev("SELECT true AS ok, count(*) AS checked_entries, CAST(NULL AS BIGINT) AS first_failure, true AS segments_ok, arg_max(entry_hash, sequence) AS head_hash FROM sealed", SEALED, recursive=True))
def verify_intact(spark, sf):
    sealed = proxy.sealed_log(spark, sf)
    return integrity.verify_chain(sealed.rows, KEY, sealed.segments, keep=[])[1]


@query("seal_lineitem", "SELECT CAST((n - 1) // 1000 AS BIGINT) AS segment_id, count(*) AS entry_count, min(n) AS first_sequence, max(n) AS last_sequence FROM (SELECT row_number() OVER () AS n FROM lineitem) GROUP BY 1")
def seal_lineitem(spark, sf):
    """The largest table as a log: segment layout after sealing every row."""
    sealed = lineitem_log(spark, sf)
    return sealed.segments.drop("segment_head")


def lineitem_log(spark, sf):
    li = proxy.table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    src = li.select(
        *order, F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), F.concat(F.lit("lineitem/"), "l_returnflag").alias("source_file"),
        F.lit("TABLE").alias("source_type"), F.col("l_orderkey").alias("source_offset"), F.lit("{}").alias("metadata_json"),
        F.to_json(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).cast("binary").alias("payload"),
    )
    return integrity.seal(src, order, segment_rows=1000, key_id=KEY)


@query("diff_log", with_ev("""SELECT 17 AS sequence, 'deleted' AS change UNION ALL SELECT 41, 'altered' UNION ALL SELECT 90, 'altered' UNION ALL SELECT 91, 'altered'
    UNION ALL SELECT sequence, 'duplicated' FROM ev WHERE sequence = 120"""))
def diff_log(spark, sf):
    """What the planted edits changed, found by comparing the log with its mirror."""
    rows = proxy.sealed_log(spark, sf).rows
    return integrity.diff_log(edited(rows), integrity.mirror(rows, "2024-02-01T00:00:00", segment_rows=64))


@query("verify_ledger", with_ev("SELECT 10 AS position, 'record hash mismatch' AS failure UNION ALL SELECT max(21), 'predecessor mismatch' FROM ev UNION ALL SELECT 30, 'record hash mismatch' FROM ev WHERE sequence = 30"))
def verify_ledger(spark, sf):
    """Failures in a mirror with one record rewritten, one dropped and one payload changed."""
    ledger = integrity.mirror(proxy.sealed_log(spark, sf).rows, "2024-02-01T00:00:00", segment_rows=64)
    at = F.col("position")
    bad = ledger.filter(at != 20).withColumn("recorded_at", F.when(at == 10, "later").otherwise(F.col("recorded_at"))).withColumn(
        "row", F.when(at == 30, F.col("row").withField("payload_b64", F.lit("eA=="))).otherwise(F.col("row"))
    )
    return integrity.verify_ledger(bad, integrity.RECOVERY, "position", keep=[]).filter(F.col("failure").isNotNull()).select("position", "failure")


def _with_dead_branches(rows):
    """A log history in which every tenth row was first written differently and then
    abandoned, as after a restore."""
    dead = rows.filter(F.col("sequence") % 10 == 3).withColumn("entry_hash", F.sha2(F.concat(F.lit("dead"), "entry_hash"), 256))
    return rows.withColumn("_alive", F.lit(1)).unionByName(dead.withColumn("_alive", F.lit(0)))


@query("reachable_chain", with_ev("SELECT sequence, entry_hash FROM sealed", SEALED, recursive=True))
def reachable_chain(spark, sf):
    """The walk back from the newest record skips all abandoned records."""
    from evidence_spark.operators.ordered import global_sequence

    both = _with_dead_branches(proxy.sealed_log(spark, sf).rows)
    placed = global_sequence(both, ["sequence", "_alive"], "position")
    ledger = placed.select("position", F.struct("sequence", "segment_id", "entry_hash", "previous_hash").alias("row"))
    return integrity.reachable_chain(ledger).select("sequence", "entry_hash")


@query("restore_log", with_ev("SELECT sequence, segment_id, entry_hash, payload FROM sealed", SEALED, recursive=True))
def restore_log(spark, sf):
    rows = proxy.sealed_log(spark, sf).rows
    restored = integrity.restore(integrity.mirror(rows, "2024-02-01T00:00:00", segment_rows=64))
    return restored.select("sequence", "segment_id", "entry_hash", F.col("payload").cast("string").alias("payload"))


@query("reconcile_log", with_ev("""SELECT max(sequence) - 1 AS log_sequence, count(*) - 1 AS log_entry_count, max(sequence) AS ledger_sequence, count(*) AS ledger_entry_count, false AS head_matches FROM ev"""))
def reconcile_log(spark, sf):
    """Heads after the last row was cut from the log."""
    rows = proxy.sealed_log(spark, sf).rows
    last = rows.agg(F.max("sequence")).first()[0]
    return integrity.reconcile(rows.filter(F.col("sequence") < last), integrity.mirror(rows, "2024-02-01T00:00:00")).drop("log_head_hash", "ledger_head_hash")


def _merkle_sql(group: str) -> str:
    return with_ev("SELECT grp AS batch, hs[1] AS merkle_root FROM tree WHERE len(hs) = 1", f"""
tree AS (SELECT {group} AS grp, list(sha256(payload) ORDER BY sequence) AS hs FROM logsrc GROUP BY 1
  UNION ALL SELECT grp, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], hs[2 * i + 1]))) FROM tree WHERE len(hs) > 1)""", recursive=True)


def _leaves(spark, sf, batch):
    src = proxy.log_source(spark, sf)
    return src.select(batch.cast("bigint").alias("batch"), F.col("order_id"), crypto.digest(F.col("payload")).alias("leaf"))


@query("merkle_roots", _merkle_sql("(sequence - 1) // 50"))
def merkle_roots(spark, sf):
    leaves = _leaves(spark, sf, F.floor((F.col("order_id") - 1) / 50)).withColumn("position", (F.col("order_id") - 1) % 50)
    return integrity.merkle_root(leaves, ["batch"], "position", "leaf")


@query("merkle_root_of_log", _merkle_sql("CAST(0 AS BIGINT)"))
def merkle_root_of_log(spark, sf):
    """One root over all entries: more than one block of leaves per shuffle round."""
    leaves = _leaves(spark, sf, F.lit(0)).withColumn("position", F.col("order_id") - 1)
    return integrity.merkle_root(leaves, ["batch"], "position", "leaf")


def evidence_records(spark, sf):
    """Full evidence records of every event."""
    from evidence_spark.operators import evidence

    ev = proxy.evidence(spark, sf).withColumns(
        {"model_used": F.col("data_format"), "recorded_at": F.col("occurred_at"), "timestamp": F.col("occurred_at")}
    )
    joined = ev.withColumn("verdict_json", evidence.verdict(ev)).select(
        "evidence_id", "recorded_at", "source_file", "source_offset", "sequence", F.sha2("src", 256).alias("entry_hash"), "verdict_json",
        F.lit("scored.csv").alias("ai_artifact_path"), F.col("source_offset").alias("ai_artifact_row_index"),
    )
    return evidence.evidence_rows(joined)


def _batch():
    return F.expr("(evidence_id - 1) div 50 + 1")


@query("verify_checkpoints", with_ev("""SELECT (sequence - 1) // 50 + 1 AS checkpoint_id, bool_and(sequence <> 777) AS batch_size_matches, bool_and(sequence NOT IN (41, 777)) AS leaf_hashes_match,
    bool_and(sequence NOT IN (41, 777)) AS merkle_root_matches, true AS ledger_matches FROM ev GROUP BY 1"""))
def verify_checkpoints(spark, sf):
    """Checks per checkpoint after one record was altered and one deleted."""
    records = evidence_records(spark, sf)
    cps = integrity.checkpoint(records.withColumn("batch", _batch()), "batch", "2024-02-01T00:00:00", segment_rows=64)
    now = records.filter(F.col("evidence_id") != 777).withColumn("severity", F.when(F.col("evidence_id") == 41, "NONE?").otherwise(F.col("severity")))
    return integrity.verify_checkpoints(cps, now)


@query("checkpoint_members", with_ev("SELECT (evidence_id - 1) // 50 + 1 AS checkpoint_id, (evidence_id - 1) % 50 AS position, evidence_id, sequence, severity FROM ev"))
def checkpoint_members(spark, sf):
    records = evidence_records(spark, sf)
    cps = integrity.checkpoint(records.withColumn("batch", _batch()), "batch", "2024-02-01T00:00:00")
    return integrity.checkpoint_members(cps.members, records).select("checkpoint_id", "position", "evidence_id", "sequence", "severity")


@query("anchors", with_ev("SELECT 2 AS anchors_checked, true AS anchors_linked, true AS head_matches FROM ev LIMIT 1"))
def anchors(spark, sf):
    """Two anchors, the first of a shorter log, checked against the log."""
    rows = proxy.sealed_log(spark, sf).rows
    first = integrity.anchor(rows.filter(F.col("sequence") <= F.lit(500)), 1, "2024-02-01T00:00:00", KEY)
    before = first.first()["anchor_hash"]
    second = integrity.anchor(rows, 2, "2024-02-02T00:00:00", KEY, previous=before)
    return integrity.verify_anchors(first.unionByName(second), rows)


@query("sync_attempts", with_ev("""SELECT attempt_id AS source_offset, 'SECURITY_EVENT' AS source_type,
    '{"details":{"attempt_id":' || attempt_id || ',"detected_at":"' || detected_at || '","operation":"' || operation || '","target_sequence":' || target_sequence || ',"sqlite_action":"blocked","trigger_details":{' || array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN '"attacker_ip":"10.0.9.' || k || '"' END, CASE WHEN k % 3 = 0 THEN '"table":"log_entries"' END], lambda x: x IS NOT NULL), ',') || '},"blocked_by_sqlite":true},"event":"tamper_attempt_blocked","severity":"HIGH"}' AS payload
    FROM att JOIN (SELECT event_id AS attempt_id, k FROM ev) USING (attempt_id) WHERE chain_entry_hash IS NULL"""))
def sync_attempts(spark, sf):
    waiting = integrity.sync_attempts(proxy.attempts(spark, sf), chain_ok=True)
    return waiting.select("source_offset", "source_type", F.col("payload").cast("string").alias("payload"))


@query("synced_attempts", with_ev("SELECT attempt_id, true AS has_hash, chain_entry_hash IS NULL AS is_new FROM att"))
def synced_attempts(spark, sf):
    """Attempts after their events were sealed: each has a hash, and new ones that of the log."""
    attempts = proxy.attempts(spark, sf)
    sealed = integrity.seal(integrity.sync_attempts(attempts, chain_ok=True).drop("attempt_id"), ["source_offset"], segment_rows=64, key_id=KEY)
    before = attempts.select("attempt_id", F.col("chain_entry_hash").alias("before"))
    after = integrity.attempts_with_hash(attempts, sealed.rows).join(before, "attempt_id")
    hashes = sealed.rows.select(F.col("source_offset").alias("attempt_id"), F.col("entry_hash").alias("sealed"))
    return after.join(hashes, "attempt_id", "left").select(
        "attempt_id", F.col("chain_entry_hash").isNotNull().alias("has_hash"), (F.col("before").isNull() & (F.col("chain_entry_hash") == F.col("sealed"))).alias("is_new")
    )


@query("restoration", with_ev("""SELECT (SELECT count(*) FROM logsrc) AS entries, (SELECT count(*) FROM logsrc) AS mapped,
    '{"details":{"actor":"analyst","reason":"drill","records_restored":' || (SELECT count(*) FROM logsrc) || '},"detected_at":"2024-03-01T00:00:00","event":"store_restored_from_recovery_ledger","severity":"CRITICAL"}' AS payload"""))
def restoration(spark, sf):
    """A log rebuilt from its mirror, with its correlation map and the event about it."""
    kept = integrity.mirror(proxy.sealed_log(spark, sf).rows, "2024-02-01T00:00:00", segment_rows=64)
    done = integrity.restoration(kept, "drill", "analyst", "2024-03-01T00:00:00")
    sizes = {"entries": F.lit(done["log"].count()), "mapped": F.lit(done["correlation_map"].count())}
    return done["event"].select(F.col("payload").cast("string").alias("payload")).withColumns(sizes)


def _readiness(spark, sf, broken):
    sealed = proxy.sealed_log(spark, sf)
    rows = edited(sealed.rows) if broken else sealed.rows
    _, chain = integrity.verify_chain(rows, KEY, sealed.segments, keep=[])
    ledger = integrity.verify_ledger(integrity.mirror(sealed.rows, "2024-02-01T00:00:00", segment_rows=64), integrity.RECOVERY, "position", keep=[])
    records = evidence_records(spark, sf)
    cps = integrity.checkpoint(records.withColumn("batch", _batch()), "batch", "2024-02-01T00:00:00")
    checks = integrity.verify_checkpoints(cps, records)
    book = integrity.ledger_summary(integrity.verify_ledger(cps.records, integrity.EVIDENCE, "checkpoint_id", keep=[]), "checkpoint_id")
    return integrity.readiness(chain, integrity.ledger_summary(ledger, "position"), book, checks, records.count(), cps.records.count())


@query("trusted_read", with_ev("SELECT evidence_id, severity FROM ev"))
def trusted_read(spark, sf):
    """A gated read of an intact log returns everything."""
    return integrity.gated(proxy.evidence(spark, sf), _readiness(spark, sf, False)).select("evidence_id", "severity")


@query("refused_read", with_ev("""SELECT false AS chain_verified, true AS recovery_ledger_verified, true AS evidence_ledger_verified, true AS checkpoints_verified,
    true AS evidence_checkpointed, false AS trusted, CAST(0 AS BIGINT) AS rows_read FROM ev LIMIT 1"""))
def refused_read(spark, sf):
    """After an edit the gate stays closed and the read returns nothing."""
    ready = _readiness(spark, sf, True)
    return ready.withColumn("rows_read", F.lit(integrity.gated(proxy.evidence(spark, sf), ready).count()))


@query("integrity_status", with_ev("""SELECT count(*) AS total_entries, min(created_at) AS first_seen, max(created_at) AS last_seen, 'verified' AS status, count(*) AS checked_entries,
    CAST(NULL AS BIGINT) AS first_failure, 'verified' AS anchor_display, 'verified' AS recovery_display FROM logsrc"""))
def integrity_status(spark, sf):
    """Status row of the integrity panel of an intact, anchored log."""
    return _panel(spark, sf, False)["status"]


@query("integrity_status_broken", with_ev("""SELECT count(*) AS total_entries, 'failed' AS status, 17 AS checked_entries, 18 AS first_failure, 'not trusted' AS anchor_display,
    'restore ready' AS recovery_display FROM logsrc WHERE sequence <> 17"""))
def integrity_status_broken(spark, sf):
    """The same after one row was deleted: reading stops at the row behind the gap."""
    return _panel(spark, sf, True)["status"].drop("first_seen", "last_seen")


def _panel(spark, sf, broken):
    sealed = proxy.sealed_log(spark, sf)
    rows = sealed.rows.filter(F.col("sequence") != 17) if broken else sealed.rows
    _, summary = integrity.verify_chain(rows, KEY, sealed.segments, keep=[])
    anchored = integrity.anchor(sealed.rows, 1, "2024-02-01T00:00:00", KEY)
    ledger = integrity.verify_ledger(integrity.mirror(sealed.rows, "2024-02-01T00:00:00", segment_rows=64), integrity.RECOVERY, "position", keep=[])
    kept = integrity.ledger_summary(ledger, "position")
    none = spark.createDataFrame([], "batch_size_matches boolean, leaf_hashes_match boolean, merkle_root_matches boolean, ledger_matches boolean")
    book = summary.select(F.lit(True).alias("ok"))
    ready = integrity.readiness(summary, kept, book, none, 0, 0)
    return integrity.integrity_panel(rows, summary, anchored, kept, ready)
