"""Tamper evidence: sealing, verification, checkpoints, mirrors and recovery.

A row-by-row hash chain is sequential, so rows are sealed in bounded segments: within a
segment every entry hash covers the hash before it, segments are folded in parallel, and
their heads are folded again, level by level, into one head. A log that fits one segment
is a plain linear chain. Verification reads only stored hashes and is parallel for both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidence_spark import policy
from evidence_spark.functions import crypto
from evidence_spark.operators.ordered import Ranges, ordered_lag, running_totals, whole_ranges
from evidence_spark.session import scratch_table, shuffle_partitions, sized

GENESIS = policy.GENESIS_HASH
MERKLE_LEVELS = 10  # tree levels taken per shuffle: blocks of 1024 leaves


# --- chains in bounded segments -----------------------------------------------------------

def segment_seed(segment: Column, previous_head: str | Column) -> Column:
    """Predecessor hash of the first row of a segment; the first segment continues the
    previous head itself."""
    head = previous_head if isinstance(previous_head, Column) else F.lit(previous_head)
    other = F.sha2(F.concat(head, F.lit(":"), segment.cast("string")), 256)
    return F.when(segment == 0, head).otherwise(other)


def fold_chain(
    df: DataFrame, sequence: str, before: str, after: str, previous_name: str, hash_name: str,
    previous_head: str = GENESIS, segment_rows: int = 4096, start: int = 1,
) -> DataFrame:
    """Chain rows numbered without gaps from ``start``.

    The text hashed for a row is ``before``, then the hash of the row before it, then
    ``after``. A segment is never larger than ``segment_rows``; its rows stream through one
    task, which keeps the last hash only.
    """
    segmented = df.withColumn("segment_id", F.floor((F.col(sequence) - start) / F.lit(segment_rows)).cast("bigint"))
    spread_out = segmented.repartition(shuffle_partitions(df.sparkSession), "segment_id").sortWithinPartitions("segment_id", sequence)
    return _folded(spread_out, sequence, before, after, previous_name, hash_name, previous_head, segment_rows, start)


def number_and_chain(
    df: DataFrame, order: list[str], sequence: str, prepare: Callable[[DataFrame], DataFrame], previous_name: str, hash_name: str,
    previous_head: str = GENESIS, segment_rows: int = 4096, start: int = 1,
) -> DataFrame:
    """Number rows over ``order`` without gaps from ``start`` and chain them.

    Ranges of whole segments are found by the order columns alone, so the rows are moved
    once. ``prepare`` works on them after that, so the long texts are never moved: it adds
    ``_before`` and ``_after`` of ``fold_chain`` and keeps ``_range``.
    """
    ranges = whole_ranges(df, order, segment_rows)
    placed = df.withColumn("_range", ranges.column).repartitionById(len(ranges.sizes), "_range").sortWithinPartitions("_range", *order)
    ready = prepare(placed)
    return _folded(ready, sequence, "_before", "_after", previous_name, hash_name, previous_head, segment_rows, start, ranges)


def _folded(
    df: DataFrame, sequence: str, before: str, after: str, previous_name: str, hash_name: str,
    previous_head: str, segment_rows: int, start: int, ranges: Ranges | None = None,
) -> DataFrame:
    """Chain rows that stand in order, segment after segment, in their partitions."""
    texts = df.withColumns({c: F.col(c).cast("binary") for c in (before, after)})
    added = [StructField("segment_id", LongType()), StructField(previous_name, StringType()), StructField(hash_name, StringType())]
    if ranges:
        added.insert(0, StructField(sequence, LongType()))
    added_names = [f.name for f in added]
    kept = [c for c in df.columns if c not in (before, after, "_range", *added_names)]
    schema = StructType([*(texts.schema[c] for c in kept), *added])
    unnumbered, starts, sizes = ranges is not None, *((ranges.starts, ranges.sizes) if ranges else ([], []))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, previous, met = None, previous_head, {}
        for batch in batches:
            if unnumbered:
                numbers = []
                for r in batch.column("_range").to_pylist():
                    at = met.get(r, 0)
                    numbers.append(start + starts[r] + at)
                    met[r] = at + 1
            else:
                numbers = batch.column(sequence).to_pylist()
            segments, befores, hashes = [], [], []
            for number, head, tail in zip(numbers, batch.column(before).to_pylist(), batch.column(after).to_pylist()):
                segment = (number - start) // segment_rows
                if segment != current:
                    current = segment
                    previous = previous_head if segment == 0 else sha256(f"{previous_head}:{segment}".encode()).hexdigest()
                segments.append(segment)
                befores.append(previous)
                previous = sha256(head + previous.encode() + tail).hexdigest()
                hashes.append(previous)
            new = [pa.array(segments, pa.int64()), pa.array(befores, pa.string()), pa.array(hashes, pa.string())]
            if unnumbered:
                new.insert(0, pa.array(numbers, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *added_names])
        short = [r for r, n in met.items() if n != sizes[r]]
        if short:  # the same input must give the same order columns twice
            raise ValueError(f"ranges {short} changed while they were numbered")

    return texts.mapInArrow(fold, schema)


def segment_heads(rows: DataFrame, sequence: str = "sequence", entry_hash: str = "entry_hash") -> DataFrame:
    return rows.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.min(sequence).alias("first_sequence"),
        F.max(sequence).alias("last_sequence"),
        F.max_by(entry_hash, sequence).alias("segment_head"),
    )


def combined_head(heads: DataFrame, fan_in: int) -> DataFrame:
    """Fold segment heads level by level, at most ``fan_in`` per group, to one row."""
    level = heads.select(F.col("segment_id").alias("_i"), F.col("segment_head").alias("_h"))
    last = level.agg(F.max("_i")).first()[0]
    while last:
        ordered = F.sort_array(F.collect_list(F.struct("_i", "_h")))
        level = level.groupBy(F.floor(F.col("_i") / fan_in).cast("bigint").alias("_g")).agg(
            F.aggregate(ordered, F.lit(GENESIS), lambda acc, x: F.sha2(F.concat(acc, x["_h"]), 256)).alias("_h")
        ).select(F.col("_g").alias("_i"), "_h")
        last //= fan_in
    return level.select(F.col("_h").alias("head_hash"))


class Sealed:
    """A chained log. Rows are stored when they are first asked for; without that, one pass
    gives the segment table."""

    def __init__(self, chained: DataFrame, fan_in: int, label: str):
        self._chained, self._fan_in, self._label = chained, fan_in, label

    @cached_property
    def rows(self) -> DataFrame:
        return scratch_table(self._chained, self._label)

    @cached_property
    def segments(self) -> DataFrame:
        stored = "rows" in self.__dict__
        return sized(segment_heads(self.rows if stored else self._chained), "segments")

    @cached_property
    def head(self) -> DataFrame:
        return combined_head(self.segments, self._fan_in)


def _json_body(**fields: Column) -> Column:
    """Members of a JSON object without the braces."""
    text = F.to_json(F.struct(*(column.alias(name) for name, column in fields.items())), {"ignoreNullFields": "false"})
    return text.substr(F.lit(2), F.length(text) - 2)


def entry_material_parts(payload_sha256: Column) -> tuple[Column, Column]:
    """Entry material around the hash of the row before (keys in sorted order)."""
    before = F.concat(
        F.lit("{"), _json_body(created_at=F.col("created_at")),
        F.lit(',"metadata":'), F.col("metadata_json"),
        F.lit(',"payload_sha256":"'), payload_sha256, F.lit('","previous_hash":"'),
    )
    after = F.concat(
        F.lit(f'","record_version":{policy.RECORD_VERSION},'),
        _json_body(
            rsa_key_id=F.col("rsa_key_id"), source_file=F.col("source_file"),
            source_offset=F.col("source_offset"), source_type=F.col("source_type"),
        ),
        F.lit("}"),
    )
    return before, after


def seal(
    df: DataFrame, order: list[str], previous_head: str = GENESIS, segment_rows: int = 4096,
    start: int = 1, key_id: str = "", label: str = "sealed",
) -> Sealed:
    """Number, hash and chain raw events (created_at, source_file, source_type,
    source_offset, metadata_json, payload)."""
    def prepare(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("rsa_key_id", F.lit(key_id)).withColumn("payload_sha256", crypto.digest(F.col("payload")))
        before, after = entry_material_parts(F.col("payload_sha256"))
        return keyed.withColumns({"_before": before, "_after": after})

    chained = number_and_chain(df, order, "sequence", prepare, "previous_hash", "entry_hash", previous_head, segment_rows, start)
    before, after = entry_material_parts(F.col("payload_sha256"))
    return Sealed(chained.withColumn("entry_material_json", F.concat(before, F.col("previous_hash"), after)), segment_rows, label)


# --- verification of the log ------------------------------------------------------------------

def legacy_entry_hash() -> Column:
    return crypto.digest(F.concat(
        F.lit('{"metadata":'), F.col("metadata_json"), F.lit(',"payload_sha256":"'), F.col("_payload_now"),
        F.lit('","previous_hash":"'), F.col("previous_hash"), F.lit('"}'),
    ))


# fixed values: checks of a log row, in the order they are reported
ROW_CHECKS = [
    "previous_hash_matches", "payload_hash_matches", "entry_material_matches",
    "entry_hash_matches", "key_id_matches", "signature_valid", "payload_auth_valid",
]


def verify_rows(
    log: DataFrame, key_id: str, previous_head: str | Column = GENESIS,
    public_key: tuple[int, int] | None = None, data_key: Column | None = None, aad: Column | None = None, logs: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Seven checks per row. Signature and payload checks pass where no key is given.
    ``logs`` names the columns that tell several logs apart; each starts from its own
    ``previous_head``. ``keep`` names the log's columns to return beside its hashes (default:
    all). What a row tells by itself is checked first, so only these are put in order."""
    log = log if "segment_id" in log.columns else log.withColumn("segment_id", F.lit(0).cast("bigint"))
    order = ["sequence", "previous_hash", "entry_hash"]
    now = log.withColumn("_payload_now", crypto.digest(F.col("payload")))
    before, after = entry_material_parts(F.col("_payload_now"))
    material = F.concat(before, F.col("previous_hash"), after)
    has_material = F.col("entry_material_json").isNotNull()
    recomputed = F.when(has_material, crypto.digest(material)).otherwise(legacy_entry_hash())
    signature = (
        crypto.signature_valid(F.col("entry_hash"), F.col("rsa_signature"), *public_key) if public_key else F.lit(True)
    )
    if data_key is not None:
        plain = F.try_aes_decrypt(F.col("payload"), data_key, F.lit("GCM"), F.lit("DEFAULT"), aad)
        encrypted = F.get_json_object("metadata_json", "$.storage") == "encrypted"
        authentic = F.when(F.coalesce(encrypted, F.lit(False)), plain.isNotNull()).otherwise(True)
    else:
        authentic = F.lit(True)
    false = F.lit(False)
    own = {
        "payload_hash_matches": F.coalesce(F.col("payload_sha256") == F.col("_payload_now"), false),
        "entry_material_matches": F.when(has_material, F.col("entry_material_json") == material).otherwise(True),
        "entry_hash_matches": F.coalesce(F.col("entry_hash") == recomputed, false),
        "key_id_matches": F.coalesce(F.col("rsa_key_id") == F.lit(key_id), false),
        "signature_valid": signature,
        "payload_auth_valid": authentic,
    }
    head = ["previous_head"] if isinstance(previous_head, Column) and "previous_head" in log.columns else []
    names = log.columns if keep is None else list(dict.fromkeys([*(logs or []), *order, "segment_id", *head, *keep]))
    checked = now.withColumns(own).select(*names, *own)
    linked = ordered_lag(checked, logs or [], order, ["entry_hash", "segment_id"])
    same = F.col("prev_segment_id").eqNullSafe(F.col("segment_id"))
    expected = F.when(same, F.col("prev_entry_hash")).otherwise(segment_seed(F.col("segment_id"), previous_head))
    matches = F.coalesce(F.col("previous_hash") == F.col("expected_previous_hash"), false)
    return linked.withColumn("expected_previous_hash", expected).select(
        *names, "expected_previous_hash", matches.alias("previous_hash_matches"), *own
    )


def row_failed() -> Column:
    failed = F.lit(False)
    for check in ROW_CHECKS:
        failed = failed | ~F.col(check)
    return failed


def verify_chain(log: DataFrame, key_id: str, segments: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Per-row checks and a one-row summary. With the stored segment table a cut at the
    end of a segment, which leaves all links intact, is found as well. The rows stand in a
    stored table, so reading them again costs a scan."""
    rows = verify_rows(log, key_id, **options)
    first = rows.filter(row_failed()).agg(F.min("sequence")).first()[0]
    ok_segments = True
    if segments is not None:
        ok_segments = verify_segments(rows, segments).filter(~F.col("segment_ok")).isEmpty()
    reached = F.lit(True) if first is None else F.col("sequence") <= F.lit(first)
    ok = first is None and ok_segments
    summary = rows.agg(
        F.lit(ok).alias("ok"),
        F.count_if(reached).alias("checked_entries"),
        F.lit(first).cast("bigint").alias("first_failure"),
        F.lit(ok_segments).alias("segments_ok"),
        (F.max_by("entry_hash", "sequence") if ok else F.lit(None).cast("string")).alias("head_hash"),
    )
    return rows, summary


def verify_logs(log: DataFrame, key_id: str, segments: DataFrame, heads: DataFrame, by: str, **options) -> DataFrame:
    """``verify_chain`` for many logs in one plan: its summary for each row of ``heads``
    (``by``, previous_head), also where the log has lost all its rows. Every log needs its
    stored segments."""
    started = log.join(sized(heads, "heads"), by)
    rows = verify_rows(started, key_id, F.col("previous_head"), logs=[by], keep=[], **options)
    first = rows.groupBy(by).agg(F.min(F.when(row_failed(), F.col("sequence"))).alias("first_failure"))
    first = sized(heads.select(by).join(first, by, "left"), "first-failures")
    reached = F.col("first_failure").isNull() | (F.col("sequence") <= F.col("first_failure"))
    counts = rows.join(first, by).groupBy(by).agg(F.count_if(reached).alias("_checked"), F.max_by("entry_hash", "sequence").alias("_head"))
    keys = [by, "segment_id"]
    now = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), F.max_by("entry_hash", "sequence").alias("_segment_head"))
    same = F.col("entry_count").eqNullSafe(F.col("_count")) & F.col("segment_head").eqNullSafe(F.col("_segment_head"))
    complete = segments.join(heads.select(by), by, "left_semi").join(now, keys, "full_outer").groupBy(by).agg(F.bool_and(same).alias("_complete"))
    joined = first.join(counts, by, "left").join(complete, by, "left").withColumn("segments_ok", F.coalesce("_complete", F.lit(False)))
    ok = F.col("first_failure").isNull() & F.col("segments_ok")
    return joined.select(
        by, ok.alias("ok"), F.coalesce("_checked", F.lit(0)).cast("bigint").alias("checked_entries"), "first_failure",
        "segments_ok", F.when(ok, F.col("_head")).alias("head_hash"),
    )


def verify_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    now = segment_heads(rows).select(
        "segment_id", F.col("entry_count").alias("_count"), F.col("segment_head").alias("_head")
    )
    same = F.col("entry_count").eqNullSafe(F.col("_count")) & F.col("segment_head").eqNullSafe(F.col("_head"))
    return segments.join(now, "segment_id", "full_outer").select("segment_id", same.alias("segment_ok"))


# --- linked ledgers ------------------------------------------------------------------------------

@dataclass(frozen=True)
class LedgerKind:
    hash_name: str
    previous_name: str
    outside_material: tuple[str, ...]


ANCHORS = LedgerKind("anchor_hash", "previous_anchor_hash", ("anchor_hash", "rsa_signature"))
RECOVERY = LedgerKind("ledger_hash", "previous_ledger_hash", ("ledger_hash", "rsa_key_id", "rsa_signature"))
EVIDENCE = LedgerKind("ledger_hash", "previous_ledger_hash", ("ledger_hash", "rsa_key_id", "rsa_signature"))


def ledger_parts(df: DataFrame, kind: LedgerKind, skip: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Canonical text of a ledger record around its predecessor hash."""
    names = sorted(c for c in df.columns if c not in kind.outside_material and c not in skip)
    at = names.index(kind.previous_name) if kind.previous_name in names else None
    if at is None:
        names = sorted([*names, kind.previous_name])
        at = names.index(kind.previous_name)
    early = _json_body(**{n: F.col(n) for n in names[:at]}) if at else None
    late = _json_body(**{n: F.col(n) for n in names[at + 1:]}) if names[at + 1:] else None
    before = F.concat(F.lit("{"), *([early, F.lit(",")] if early is not None else []), F.lit(f'"{kind.previous_name}":"'))
    after = F.concat(F.lit('"'), *([F.lit(","), late] if late is not None else []), F.lit("}"))
    return before, after


def link_ledger(df: DataFrame, kind: LedgerKind, position: str, previous_head: str = GENESIS, segment_rows: int = 4096, start: int = 1) -> DataFrame:
    """Add predecessor and record hashes to ledger records numbered by ``position``.
    ``position`` orders the ledger and is not part of the hashed text."""
    before, after = ledger_parts(df, kind, (position,))
    texts = df.withColumn("_before", before).withColumn("_after", after)
    return fold_chain(texts, position, "_before", "_after", kind.previous_name, kind.hash_name, previous_head, segment_rows, start)


def verify_ledger(
    df: DataFrame, kind: LedgerKind, position: str, previous_head: str = GENESIS, public_key: tuple[int, int] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Ledger rows with ``failure``: the first check that fails, null when none does.
    ``keep`` names the columns to return beside position, segment and hashes (default: all);
    as in ``verify_rows`` only these are put in order."""
    df = df if "segment_id" in df.columns else df.withColumn("segment_id", F.lit(0).cast("bigint"))
    before, after = ledger_parts(df, kind, (position, "segment_id"))
    recomputed = crypto.digest(F.concat(before, F.col(kind.previous_name), after))
    wrong = F.when(F.lit(False), F.lit(""))
    if public_key:
        wrong = wrong.when(
            ~F.coalesce(crypto.signature_valid(F.col(kind.hash_name), F.col("rsa_signature"), *public_key), F.lit(False)),
            "signature invalid",
        )
    if "row" in df.columns:
        row_material = F.col("row.entry_material_json")
        legacy = F.concat(
            F.lit('{"metadata":'), F.col("row.metadata_json"), F.lit(',"payload_sha256":"'), F.col("row.payload_sha256"),
            F.lit('","previous_hash":"'), F.col("row.previous_hash"), F.lit('"}'),
        )
        wrong = wrong.when(
            ~F.col("row.payload_sha256").eqNullSafe(crypto.digest(F.unbase64("row.payload_b64"))), "payload hash mismatch"
        ).when(
            ~F.col("row.entry_hash").eqNullSafe(crypto.digest(F.coalesce(row_material, legacy))), "entry hash mismatch"
        )
    names = df.columns if keep is None else list(dict.fromkeys([position, "segment_id", kind.previous_name, kind.hash_name, *keep]))
    own = {"_record": F.col(kind.hash_name).eqNullSafe(recomputed), "_wrong": wrong}
    linked = ordered_lag(df.withColumns(own).select(*names, *own), [], [position], [kind.hash_name, "segment_id"])
    same = F.col("prev_segment_id").eqNullSafe(F.col("segment_id"))
    expected = F.when(same, F.col(f"prev_{kind.hash_name}")).otherwise(segment_seed(F.col("segment_id"), previous_head))
    failure = (
        F.when(~F.col("_record"), "record hash mismatch")
        .when(~F.col(kind.previous_name).eqNullSafe(expected), "predecessor mismatch")
        .otherwise(F.col("_wrong"))
    )
    return linked.select(*names, failure.alias("failure"))


def ledger_summary(verified: DataFrame, position: str) -> DataFrame:
    return verified.agg(
        F.count(F.lit(1)).alias("records_checked"),
        (F.count("failure") == 0).alias("ok"),
        F.min(F.when(F.col("failure").isNotNull(), F.col(position))).alias("first_failure"),
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col(position))).alias("reason"),
    )


# --- Merkle roots and checkpoints ----------------------------------------------------------------

def _take_levels(leaves: Column, levels: Column) -> Column:
    """Hash neighbours pairwise ``levels`` times; an odd level repeats its last hash."""
    def one_level(acc, _):
        last = F.size(acc) - 1
        pairs = F.sequence(F.lit(0), F.floor(last / 2).cast("int"))
        return F.transform(
            pairs,
            lambda i: F.sha2(F.concat(F.get(acc, i * 2), F.get(acc, F.least(i * 2 + 1, last))), 256),
        )

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, leaves, one_level)


def merkle_root(df: DataFrame, group: list[str], position: str, leaf: str) -> DataFrame:
    """Root per group. ``position`` numbers the leaves of a group from 0 without gaps.

    One shuffle takes ten levels: a block of 1024 neighbouring leaves is folded inside
    one row, and only the last, partial block of a group needs to know whether other
    blocks exist (then it must climb all ten levels too).
    """
    block = 1 << MERKLE_LEVELS
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("leaf_count"))
    largest = sizes.agg(F.max("leaf_count")).first()[0] or 0
    level = df.select(*group, F.col(position).cast("bigint").alias("_i"), F.col(leaf).alias("_h"))
    while True:
        inside = F.sort_array(F.collect_list(F.struct("_i", "_h")))
        blocks = level.groupBy(*group, F.floor(F.col("_i") / block).cast("bigint").alias("_b")).agg(
            F.transform(inside, lambda x: x["_h"]).alias("_leaves")
        )
        blocks = blocks.join(sizes.select(*group, F.col("leaf_count").alias("_n")), group)
        own = F.ceil(F.log2(F.size("_leaves").cast("double"))).cast("int")
        levels = F.when(F.col("_n") > block, F.lit(MERKLE_LEVELS)).otherwise(own)
        level = blocks.select(*group, F.col("_b").alias("_i"), F.get(_take_levels(F.col("_leaves"), levels), F.lit(0)).alias("_h"))
        if largest <= block:
            break
        sizes = sizes.withColumn("leaf_count", F.ceil(F.col("leaf_count") / block).cast("bigint"))
        largest = -(-largest // block)
    return level.select(*group, F.col("_h").alias("merkle_root"))


# fixed values: fields of an evidence record that its leaf hash covers
LEAF_FIELDS = [
    "evidence_id", "recorded_at", "source_file", "source_offset", "sequence", "entry_hash",
    "ai_artifact_path", "ai_artifact_row_index", "ai_result_sha256", "verdict_json",
    "model_used", "predicted_anomaly", "severity",
]


def leaf_hash() -> Column:
    """Hash of one evidence record. The score enters in millionths, a whole number, so
    that the text does not depend on how an engine prints floating point."""
    fields = {name: F.col(name) for name in LEAF_FIELDS}
    fields["anomaly_score_micro"] = F.floor(F.col("anomaly_score") * F.lit(1e6) + F.lit(0.5)).cast("bigint")
    return crypto.digest(crypto.canonical(fields))


@dataclass
class Checkpoints:
    records: DataFrame
    members: DataFrame


def checkpoint(
    evidence: DataFrame, batch: str, created_at: str, checkpoint_type: str = "evidence_batch",
    previous_head: str = GENESIS, start: int = 1, segment_rows: int = 4096,
) -> Checkpoints:
    """One checkpoint per value of ``batch`` (numbered from ``start``), with explicit
    membership, so interleaved batches verify too."""
    leaves = evidence.select(F.col(batch).cast("bigint").alias("checkpoint_id"), "evidence_id", leaf_hash().alias("leaf_hash"))
    numbered = running_totals(leaves, ["checkpoint_id", "evidence_id"], {"_n": F.lit(1)})
    firsts = numbered.groupBy("checkpoint_id").agg(F.min("_n").alias("_first"))
    members = scratch_table(
        numbered.join(firsts, "checkpoint_id").withColumn("position", F.col("_n") - F.col("_first")).drop("_n", "_first"),
        "members",
    )
    roots = merkle_root(members, ["checkpoint_id"], "position", "leaf_hash")
    spans = members.groupBy("checkpoint_id").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.min("evidence_id").alias("first_evidence_id"),
        F.max("evidence_id").alias("last_evidence_id"),
    )
    records = spans.join(roots, "checkpoint_id").withColumns(
        {"created_at": F.lit(created_at), "checkpoint_type": F.lit(checkpoint_type), "version": F.lit(1)}
    )
    linked = link_ledger(records, EVIDENCE, "checkpoint_id", previous_head, segment_rows, start)
    return Checkpoints(linked, members)


def checkpoint_members(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored members with the evidence rows they name (null when the row is gone)."""
    current = evidence.withColumn("_leaf_now", leaf_hash())
    return members.join(current, "evidence_id", "left")


def verify_checkpoints(checkpoints: Checkpoints, evidence: DataFrame, previous_head: str = GENESIS, public_key=None) -> DataFrame:
    joined = scratch_table(
        checkpoint_members(checkpoints.members, evidence.select(*LEAF_FIELDS, "anomaly_score")).select(
            "checkpoint_id", "position", "leaf_hash", F.coalesce("_leaf_now", F.lit("missing")).alias("_leaf_now"),
        ),
        "leaves",
    )
    per = joined.groupBy("checkpoint_id").agg(
        F.count_if(F.col("_leaf_now") != "missing").alias("_rows"),
        F.bool_and(F.col("leaf_hash") == F.col("_leaf_now")).alias("leaf_hashes_match"),
    )
    roots = merkle_root(joined, ["checkpoint_id"], "position", "_leaf_now").withColumnRenamed("merkle_root", "_root")
    linked = verify_ledger(checkpoints.records, EVIDENCE, "checkpoint_id", previous_head, public_key)
    none = F.lit(False)
    return linked.join(per, "checkpoint_id", "left").join(roots, "checkpoint_id", "left").select(
        "checkpoint_id",
        F.coalesce(F.col("batch_size") == F.col("_rows"), none).alias("batch_size_matches"),
        F.coalesce("leaf_hashes_match", none).alias("leaf_hashes_match"),
        F.coalesce(F.col("merkle_root") == F.col("_root"), none).alias("merkle_root_matches"),
        F.col("failure").isNull().alias("ledger_matches"),
    )


# --- anchors, mirrors, recovery --------------------------------------------------------------------

def chain_head(log: DataFrame) -> DataFrame:
    return log.agg(
        F.coalesce(F.max("sequence"), F.lit(0)).alias("sequence"),
        F.count(F.lit(1)).alias("entry_count"),
        F.coalesce(F.max_by("entry_hash", "sequence"), F.lit(GENESIS)).alias("head_hash"),
    )


def anchor(log: DataFrame, position: int, created_at: str, key_id: str, ledger_hash: str = GENESIS, previous: str = GENESIS) -> DataFrame:
    """One anchor record of the current head, linked to the anchor before it."""
    record = chain_head(log).filter(F.col("entry_count") > 0).withColumns(
        {
            "version": F.lit(2), "created_at": F.lit(created_at), "recovery_ledger_hash": F.lit(ledger_hash),
            "previous_anchor_hash": F.lit(previous), "rsa_key_id": F.lit(key_id),
        }
    )
    before, after = ledger_parts(record, ANCHORS)
    text = F.concat(before, F.col("previous_anchor_hash"), after)
    return record.withColumn("anchor_hash", crypto.digest(text)).withColumn("position", F.lit(position).cast("bigint"))


def verify_anchors(anchors: DataFrame, log: DataFrame, public_key=None) -> DataFrame:
    """One row: all anchors linked, and the latest equal to the head of the log."""
    verified = verify_ledger(anchors, ANCHORS, "position", GENESIS, public_key)
    latest = verified.agg(
        F.count(F.lit(1)).alias("anchors_checked"),
        (F.count("failure") == 0).alias("anchors_linked"),
        *(F.max_by(c, "position").alias(f"_{c}") for c in ("sequence", "entry_count", "head_hash")),
    ).first()
    matches = (
        (F.col("sequence") == F.lit(latest["_sequence"]))
        & (F.col("entry_count") == F.lit(latest["_entry_count"]))
        & (F.col("head_hash") == F.lit(latest["_head_hash"]))
    )
    return chain_head(log).select(
        F.lit(latest["anchors_checked"]).alias("anchors_checked"),
        F.lit(latest["anchors_linked"]).alias("anchors_linked"),
        F.coalesce(matches, F.lit(False)).alias("head_matches"),
    )


# fixed values: fields of a log row that the recovery ledger keeps
MIRROR_FIELDS = [
    "sequence", "segment_id", "created_at", "source_file", "source_type", "source_offset", "metadata_json",
    "payload_sha256", "previous_hash", "entry_hash", "rsa_key_id", "entry_material_json",
]


def mirror(log: DataFrame, recorded_at: str, previous_head: str = GENESIS, start: int = 1, segment_rows: int = 4096) -> DataFrame:
    """Recovery ledger: a full copy of every log row, linked on its own."""
    log = log if "segment_id" in log.columns else log.withColumn("segment_id", F.lit(0).cast("bigint"))
    def prepare(rows: DataFrame) -> DataFrame:
        row = F.struct(*MIRROR_FIELDS, crypto.b64(F.col("payload")).alias("payload_b64"))
        records = rows.select("_range", row.alias("row"), F.lit(recorded_at).alias("recorded_at"), F.lit(1).alias("version"))
        before, after = ledger_parts(records, RECOVERY, ("_range",))
        return records.withColumns({"_before": before, "_after": after})

    kept = log.select(*MIRROR_FIELDS, "payload")
    return number_and_chain(kept, ["sequence"], "position", prepare, RECOVERY.previous_name, RECOVERY.hash_name, previous_head, segment_rows, start)


FEW_SPANS = 64


def reachable_chain(ledger: DataFrame, previous_head: str = GENESIS) -> DataFrame:
    """Mirror records on the way from the last record back to the start."""
    runs, spans = reachable_spans(ledger, previous_head)
    kept = runs.join(spans.select("run", "upto"), "run").filter(F.col("position") <= F.col("upto"))
    return kept.select("position", "sequence", "entry_hash", "previous_hash")


def reachable_spans(ledger: DataFrame, previous_head: str = GENESIS) -> tuple[DataFrame, DataFrame]:
    """The records with their runs, and the part of each run (``first`` to ``upto``) that
    lies on the way from the last record back to the start.

    Neighbouring records that link to each other form a run. Runs are few unless the
    ledger is full of breaks, and the walk from run to run is done by doubling, so the
    number of rounds grows with the logarithm of the number of breaks. A hash met in
    several records stands for the latest of them.
    """
    flat = ledger.select(
        "position", F.col("row.segment_id").alias("segment_id"), F.col("row.entry_hash").alias("entry_hash"),
        F.col("row.previous_hash").alias("previous_hash"), F.col("row.sequence").alias("sequence"),
    ).withColumn("_seeded", (F.col("segment_id") > 0) & (F.col("previous_hash") == segment_seed(F.col("segment_id"), previous_head)))
    lagged = ordered_lag(flat, [], ["position"], ["entry_hash", "segment_id", "sequence"])
    follows = F.when(
        F.col("_seeded"), (F.col("prev_segment_id") == F.col("segment_id") - 1) & (F.col("prev_sequence") == F.col("sequence") - 1)
    ).otherwise(F.col("previous_hash") == F.col("prev_entry_hash"))
    linked = F.coalesce(follows, F.lit(False))
    # both stand in stored tables; the rows that break the chain are the starts of runs
    runs = running_totals(lagged.withColumn("_break", (~linked).cast("int")), ["position"], {"run": F.col("_break")})
    starts = sized(
        runs.filter("_break = 1").select(F.col("run").alias("child"), "previous_hash", "segment_id", "_seeded", F.col("position").alias("first")), "starts"
    )
    here = F.max(F.struct("position", "run")).alias("_at")
    hashes = starts.filter(~F.col("_seeded")).select(F.col("previous_hash").alias("entry_hash"))
    latest = runs.join(hashes, "entry_hash", "left_semi").groupBy("entry_hash").agg(here)
    before = starts.filter("_seeded").select((F.col("segment_id") - 1).alias("segment_id"))
    closing = runs.join(before, "segment_id", "left_semi").groupBy("segment_id").agg(F.max_by(F.struct("position", "run"), F.struct("sequence", "position")).alias("_at"))
    by_hash = starts.filter(~F.col("_seeded")).join(latest, starts.previous_hash == latest.entry_hash).select("child", "_at")
    by_segment = starts.filter("_seeded").withColumn("segment_id", F.col("segment_id") - 1).join(closing, "segment_id").select("child", "_at")
    jumps = scratch_table(
        by_hash.unionByName(by_segment).select("child", F.col("_at.run").alias("parent"), F.col("_at.position").alias("upto")), "jumps"
    )
    tail = runs.agg(F.max_by("run", "position"), F.max("position"), F.max("run") + 1).first()
    spark = ledger.sparkSession
    reached = spark.createDataFrame([(tail[0], tail[1])], "run bigint, upto bigint")
    hop = jumps.filter(F.col("parent") < F.col("child")).select("child", "parent", "upto")
    rounds = max(1, (tail[2] or 1).bit_length())
    for _ in range(rounds):
        if hop.isEmpty():
            break
        further = reached.join(hop, reached.run == hop.child).select(hop.parent.alias("run"), hop.upto)
        reached = scratch_table(reached.unionByName(further).groupBy("run").agg(F.max("upto").alias("upto")), "reached")
        ahead = hop.select(F.col("child").alias("parent"), F.col("parent").alias("_next"), F.col("upto").alias("_upto"))
        hop = scratch_table(hop.join(ahead, "parent").select("child", F.col("_next").alias("parent"), F.col("_upto").alias("upto")), "hop")
    return runs, starts.select(F.col("child").alias("run"), "first").join(reached, "run")


def restore(ledger: DataFrame, public_key=None) -> DataFrame:
    """Log rows rebuilt from a mirror; refused when the mirror itself is not intact."""
    ledger = scratch_table(ledger, "ledger")
    failures = verify_ledger(ledger, RECOVERY, "position", GENESIS, public_key, keep=[]).filter(F.col("failure").isNotNull())
    if not failures.isEmpty():
        raise ValueError("the mirror does not verify; nothing restored")
    spans = reachable_spans(ledger)[1]
    few = spans.limit(FEW_SPANS + 1).collect()
    if len(few) <= FEW_SPANS:  # the usual mirror is one run: no wide row has to move
        inside = F.lit(False)
        for span in few:
            inside = inside | F.col("position").between(span["first"], span["upto"])
        rows = ledger.filter(inside)
    else:
        rows = ledger.join(reachable_chain(ledger).select("position"), "position", "left_semi")
    return rows.select(
        *(F.col(f"row.{name}").alias(name) for name in MIRROR_FIELDS), F.unbase64("row.payload_b64").alias("payload")
    )


def restoration(ledger: DataFrame, reason: str, actor: str, restored_at: str, public_key=None) -> dict[str, DataFrame]:
    """The restored log, its correlation map, and the critical event that records the
    restoration, ready to be sealed behind it."""
    from evidence_spark.operators.evidence import correlation_map, security_event

    rows = restore(ledger, public_key)
    done = rows.agg(F.count(F.lit(1)).alias("records_restored"), F.max("sequence").alias("source_offset"))
    details = F.to_json(F.struct(F.lit(actor).alias("actor"), F.lit(reason).alias("reason"), "records_restored"))
    event = security_event(done, F.lit("store_restored_from_recovery_ledger"), F.lit("CRITICAL"), F.lit(restored_at), details)
    mapped = rows if "payload_sha256" in rows.columns else rows.withColumn("payload_sha256", crypto.digest(F.col("payload")))
    return {"log": rows, "correlation_map": correlation_map(mapped), "event": event}


def diff_log(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sequences that were deleted, altered, added or duplicated against the mirror."""
    now = log.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("entry_hash").alias("_low"), F.max("entry_hash").alias("_high"),
        F.bool_and(crypto.digest(F.col("payload")) == F.col("payload_sha256")).alias("_intact"),
    )
    kept = ledger.groupBy(F.col("row.sequence").alias("sequence")).agg(F.max_by("row.entry_hash", "position").alias("_kept"))
    change = (
        F.when(F.col("_rows").isNull(), "deleted")
        .when(F.col("_kept").isNull(), "added")
        .when(F.col("_rows") > 1, "duplicated")
        .when((F.col("_low") != F.col("_kept")) | ~F.col("_intact"), "altered")
    )
    return now.join(kept, "sequence", "full_outer").select("sequence", change.alias("change")).filter(F.col("change").isNotNull())


def reconcile(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Heads of log and mirror side by side; the entry count is the real count."""
    mirrored = ledger.select("row.sequence", "row.entry_hash")
    a, b = chain_head(log), chain_head(mirrored)
    left = a.select(F.lit(1).alias("_one"), *(F.col(c).alias(f"log_{c}") for c in a.columns))
    right = b.select(F.lit(1).alias("_one"), *(F.col(c).alias(f"ledger_{c}") for c in b.columns))
    same = (F.col("log_sequence") == F.col("ledger_sequence")) & (F.col("log_head_hash") == F.col("ledger_head_hash")) & (
        F.col("log_entry_count") == F.col("ledger_entry_count")
    )
    return left.join(right, "_one").drop("_one").withColumn("head_matches", same)


def sync_attempts(attempts: DataFrame, chain_ok: bool, limit: int | None = None) -> DataFrame:
    """Unsynced attempts as raw security events; none while the chain does not verify."""
    from evidence_spark.operators.filters import unsynced_attempts

    waiting = unsynced_attempts(attempts, limit).filter(F.lit(bool(chain_ok)))
    own = F.from_json(F.coalesce("details_json", F.lit("{}")), "map<string,string>")
    details = F.to_json(F.struct(
        "attempt_id", "detected_at", "operation", "target_sequence", "sqlite_action", own.alias("trigger_details"), F.lit(True).alias("blocked_by_sqlite")
    ))
    body = F.concat(
        F.lit('{"details":'), details, F.lit(',"event":"tamper_attempt_blocked","severity":"HIGH"}')
    )
    return waiting.select(
        "attempt_id",
        F.col("detected_at").alias("created_at"),
        F.lit("security_monitor").alias("source_file"),
        F.lit("SECURITY_EVENT").alias("source_type"),
        F.col("attempt_id").alias("source_offset"),
        F.lit('{"event_name":"tamper_attempt_blocked","ingest_mode":"security_event","severity":"HIGH"}').alias("metadata_json"),
        body.cast("binary").alias("payload"),
    )


def attempts_with_hash(attempts: DataFrame, log: DataFrame) -> DataFrame:
    """Attempts whose security event is in the sealed ``log``, with its entry hash; a hash
    that is there already stays."""
    sealed = log.filter((F.col("source_type") == "SECURITY_EVENT") & (F.col("source_file") == "security_monitor"))
    hashes = sealed.groupBy(F.col("source_offset").alias("attempt_id")).agg(F.min_by("entry_hash", "sequence").alias("_hash"))
    joined = attempts.join(hashes, "attempt_id", "left").withColumn("chain_entry_hash", F.coalesce("chain_entry_hash", "_hash"))
    return joined.select(*attempts.columns)


# --- trust gate ----------------------------------------------------------------------------------------

def readiness(
    chain: DataFrame, recovery: DataFrame, evidence_ledger: DataFrame, checkpoints: DataFrame,
    evidence_count: int, checkpoint_count: int,
) -> DataFrame:
    """One row of the five checks. The first three inputs are one-row summaries with
    ``ok``; ``checkpoints`` holds one row of checks per checkpoint."""
    passed = F.lit(True)
    for name in ("batch_size_matches", "leaf_hashes_match", "merkle_root_matches", "ledger_matches"):
        passed = passed & F.col(name)
    values = {
        "chain_verified": bool(chain.first()["ok"]),
        "recovery_ledger_verified": bool(recovery.first()["ok"]),
        "evidence_ledger_verified": bool(evidence_ledger.first()["ok"]),
        "checkpoints_verified": checkpoints.filter(~passed).isEmpty(),
        "evidence_checkpointed": evidence_count == 0 or checkpoint_count > 0,
    }
    row = {**values, "trusted": all(values.values())}
    schema = ", ".join(f"{name} boolean" for name in row)
    return chain.sparkSession.createDataFrame([tuple(row.values())], schema)


def gated(df: DataFrame, ready: DataFrame, require: bool = False) -> DataFrame:
    """``df`` when the readiness row is trusted, otherwise no rows (or an error)."""
    row = ready.first()
    if require and not row["trusted"]:
        raise PermissionError(f"trusted read refused: {row.asDict()}")
    return df.filter(F.lit(bool(row["trusted"])))


def integrity_panel(log: DataFrame, summary: DataFrame, anchors: DataFrame, mirror_summary: DataFrame, ready: DataFrame) -> dict[str, DataFrame]:
    """The status view: one-row tables by name plus the lists it shows."""
    from evidence_spark.operators import aggregates, feeds

    chain, kept = summary.first(), mirror_summary.first()
    anchored = not anchors.isEmpty()
    span = aggregates.log_span(log)
    status = (
        F.when(F.col("total_entries") == 0, "empty")
        .when(F.lit(not chain["ok"]), "failed")
        .when(F.lit(not anchored), "unanchored")
        .otherwise("verified")
    )
    mirror_state = "verified" if kept["ok"] else "failed"
    return {
        "status": span.withColumns(
            {
                "status": status,
                "checked_entries": F.lit(chain["checked_entries"]),
                "first_failure": F.lit(chain["first_failure"]).cast("bigint"),
                "anchor_display": F.lit(("verified" if anchored else "missing") if chain["ok"] else "not trusted"),
                "recovery_display": F.lit("restore ready" if not chain["ok"] and kept["ok"] else mirror_state),
            }
        ),
        "head": chain_head(log),
        "readiness": ready,
        "source_summary": aggregates.source_summary(log),
        "sequence_entries": feeds.sequence_entries(log),
        "anchor_history": feeds.anchor_history(anchors),
    }


