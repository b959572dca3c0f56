"""Join operators. Catalyst chooses the strategy; a broadcast is hinted only where the
small side has one row per domain, per partition or per requested key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators.filters import page
from evidence_spark.operators.ordered import ordered_lag
from evidence_spark.session import scratch_table, sized


def attach_labels(packets: DataFrame, labels: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Packets with the label of their own capture's sidecar, 0 where it has none. A packet
    listed twice counts as an anomaly if either line says so."""
    keys = on or ["source_file", "packet_index"]
    once = labels.groupBy(*keys).agg(F.max(F.col("is_anomaly").cast("bigint")).alias("is_anomaly"))
    return packets.drop("is_anomaly").join(once, keys, "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(0))
    )


def attach_bit_fields(events: DataFrame, raw: DataFrame, on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Word events with their bit fields, and the events that have none. The join is on
    row identity, so equal timestamps cannot multiply rows."""
    keys = on or ["source_file", "source_offset"]
    fields = raw.select(*keys, "ssm_bits", "data_bits", "raw_hex")
    return events.join(fields, keys, "left"), events.join(fields, keys, "left_anti")


def apply_zscores(df: DataFrame, stats: DataFrame, key: str, columns: list[str], upper_tail_only: bool = True) -> DataFrame:
    """Add ``<column>_zscore`` from per-group mean and deviation. A group without
    statistics keeps its rows and uses mean 0 and deviation 1."""
    joined = df.join(sized(stats, "stats"), key, "left")
    out = {}
    for name in columns:
        mean, std = F.col(f"{name}_mean"), F.col(f"{name}_std")
        mean, std = F.coalesce(mean, F.lit(0.0)), F.coalesce(std, F.lit(1.0))
        z = (F.col(name) - mean) / std
        out[f"{name}_zscore"] = F.greatest(z, F.lit(0.0)) if upper_tail_only else z
    return joined.withColumns(out).drop(*(f"{c}_{s}" for c in columns for s in ("mean", "std")))


def correlate(keys: DataFrame, log: DataFrame, latest: bool = True) -> DataFrame:
    """The latest (or first) log row per (source_file, source_offset)."""
    pick = F.max_by if latest else F.min_by
    row = F.struct("sequence", "entry_hash", "source_type", "payload_sha256", "created_at")
    on = ["source_file", "source_offset"]
    chosen = log.groupBy(*on).agg(pick(row, F.col("sequence")).alias("_row"))
    return keys.join(chosen, on).select(*keys.columns, "_row.*")


def attach_evidence(scored: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows with the log row they belong to, and counts of hits and misses."""
    on = ["source_file", "source_offset"]
    heads = log.groupBy(*on).agg(F.max_by(F.struct("sequence", "entry_hash"), F.col("sequence")).alias("_row"))
    joined = scored.drop("sequence", "entry_hash").join(heads, on, "left").select(
        *(c for c in scored.columns if c not in ("sequence", "entry_hash")), "_row.sequence", "_row.entry_hash"
    )
    report = joined.agg(
        F.count("sequence").alias("attached"), F.count_if(F.col("sequence").isNull()).alias("missing_mappings")
    )
    return joined.filter(F.col("sequence").isNotNull()), report


def replay_base(log: DataFrame, evidence: DataFrame) -> DataFrame:
    left = log.select("sequence", "created_at", "source_type")
    return left.join(evidence.drop("created_at", "source_type"), "sequence")


def attach_artifact(evidence: DataFrame, scored: DataFrame, columns: list[str]) -> DataFrame:
    """Evidence with fields of the scored row it points to (path, row index)."""
    side = scored.select(
        F.col("artifact_path").alias("ai_artifact_path"), F.col("row_index").alias("ai_artifact_row_index"),
        *(F.col(c).alias(f"artifact_{c}") for c in columns),
    )
    return evidence.join(side, ["ai_artifact_path", "ai_artifact_row_index"], "left")


#: Relation and label of two events that agree in the columns, strongest first.
PAIR_RULES = [
    (["source_component", "target_component"], "shared_flow", "same flow"),
    (None, "pivot", "pivot"),  # the target of the earlier event is the source of the later one
    (["target_component"], "shared_target", "same target"),
    (["pattern"], "shared_pattern", "same pattern"),
    (["source_component"], "shared_source", "same source"),
    (["domain"], "domain_sequence", "same domain"),  # within a span of time
]


def correlate_events(selected: DataFrame, seconds: int = policy.SAME_DOMAIN_SECONDS) -> DataFrame:
    """Related events as links, earlier event first.

    By each rule an event is linked to the last event before it with the same key, so links
    grow with the events, and whatever is related is connected through the events between.
    Of two links between the same events the strongest relation stays. A pivot links an
    event to the row before it among the targets and sources of its component, if that is
    another event's target; between two sources stands a shared source already.
    """
    need = ["rank", "event_id", "source_component", "target_component", "pattern", "domain", "event_us"]
    events = scratch_table(selected.select(*need), "pairs")
    found = None
    for precedence, (columns, relation, label) in enumerate(PAIR_RULES):
        if columns is None:
            sources = events.select(F.col("source_component").alias("_at"), "rank", F.lit(0).alias("_target"), "event_id")
            targets = events.select(F.col("target_component").alias("_at"), "rank", F.lit(1).alias("_target"), "event_id")
            before = ordered_lag(sources.unionByName(targets), ["_at"], ["rank", "_target", "event_id"], ["event_id", "_target"])
            linked = before.filter("_target = 0 AND prev__target = 1 AND _at IS NOT NULL")
        else:
            before = ordered_lag(events, columns, ["rank", "event_id"], ["event_id", "event_us"])
            linked = before.filter(F.col("prev_event_id").isNotNull())
            for c in columns:
                linked = linked.filter(F.col(c).isNotNull())
            if relation == "domain_sequence":
                linked = linked.filter(F.col("event_us") - F.col("prev_event_us") <= seconds * 1_000_000)
        part = linked.select(F.col("prev_event_id").alias("source"), F.col("event_id").alias("target"), F.lit(precedence).alias("_p"), F.lit(relation).alias("relation"), F.lit(label).alias("label"))
        found = part if found is None else found.unionByName(part)
    strongest = F.min_by(F.struct("relation", "label"), F.col("_p")).alias("_r")
    return found.filter("source <> target").groupBy("source", "target").agg(strongest).select("source", "target", "_r.relation", "_r.label")


def new_attempts(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """Attempts that no security event reports yet."""
    return attempts.join(events.select("attempt_id").filter(F.col("attempt_id").isNotNull()), "attempt_id", "left_anti")


def records_for(sequences: DataFrame, pool: DataFrame, limit: int | None = None) -> DataFrame:
    """Pool records of the requested sequences in pool order."""
    return page(pool.join(sequences, "sequence", "left_semi").orderBy("sequence", "evidence_id"), limit)


def related_subgraph(nodes: DataFrame, edges: DataFrame, tokens: list[str], text_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes whose text mentions a token, and the edges that touch them."""
    cols = text_cols or ["id", "label"]
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in cols))
    matched = nodes.filter(scalars.contains_any(text, [t for t in tokens if t]))
    ids = matched.select("id")
    out = edges.join(ids, edges.source == ids.id, "left_semi")
    into = edges.join(ids, edges.target == ids.id, "left_semi")
    return matched, out.unionByName(into).dropDuplicates(["source", "target", "relation"])


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Edges of one node with the direction and the label of the other end."""
    out = edges.filter(F.col("source") == node_id).select(F.lit("Outgoing").alias("direction"), F.col("target").alias("other"), "relation", "label")
    into = edges.filter((F.col("target") == node_id) & (F.col("source") != node_id)).select(
        F.lit("Incoming").alias("direction"), F.col("source").alias("other"), "relation", "label"
    )
    names = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("kind").alias("other_kind"))
    return out.unionByName(into).join(names, "other", "left")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, n: int, order: list) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` nodes and the edges between them."""
    kept = nodes.orderBy(*order).limit(n)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept, inside.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def missing_sources(log: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Capture and label files next to logged CSV files that are not logged yet."""
    key = scalars.canonical_source(F.col("source_file"), root)
    logged = log.select(key.alias("key")).distinct()
    scores = F.lower("key").endswith("_scores.csv") | F.lower("key").endswith("_labels.csv")
    folders = logged.filter(F.col("key").endswith(".csv") & ~scores).select(
        F.regexp_extract("key", r"^(.*)/[^/]*$", 1).alias("folder")
    ).distinct()
    files = listing.select("source_file", key.alias("key")).withColumn("folder", F.regexp_extract("key", r"^(.*)/[^/]*$", 1))
    wanted = files.filter(F.col("key").endswith(".pcap") | F.col("key").endswith("_labels.csv"))
    return wanted.join(folders, "folder", "left_semi").join(logged, "key", "left_anti").select("source_file")
