"""Batch detection plan: files or tables to unified events, features, scores, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.schemas import BASE_EVENT_COLUMNS, UNIFIED


def words_to_unified(words: DataFrame) -> DataFrame:
    """Bus words in the unified shape: label to bus, size of the data field, no port."""
    return words.select(
        F.col("timestamp").cast("double").alias("timestamp"),
        F.lit(policy.WORD_DOMAIN).alias("domain"),
        F.lit(policy.WORD_FORMAT).alias("data_format"),
        F.col("label_octal").cast("string").alias("src"),
        F.lit(policy.WORD_BUS).alias("dst"),
        scalars.bits_to_bytes(F.col("data_bits")).alias("packet_size"),
        F.col("frequency"),
        F.lit(policy.WORD_FORMAT).alias("protocol"),
        F.lit(0).cast("bigint").alias("port"),
        F.col("is_anomaly").cast("bigint").alias("is_anomaly"),
    )


def conform(df: DataFrame) -> DataFrame:
    """The unified schema: rows with any null dropped, types enforced, flags added."""
    base = df.select(*BASE_EVENT_COLUMNS).dropna(how="any")
    typed = base.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in UNIFIED.fields[:10]))
    return scalars.security_flags(typed).select(*UNIFIED.names)


def detect(packets: DataFrame, words: DataFrame, row_id: str, n_trees: int = 200, sample_size: int = 256, seed: int = 42):
    """Train, score and explain packet rows per domain and bus words as one more group.

    Returns the scored rows and the explained flagged rows of both kinds.
    """
    from evidence_spark.operators import aggregates, filters, forest
    from evidence_spark.session import scratch_table

    stats = scratch_table(aggregates.domain_baseline(packets), "stats")
    p = scratch_table(forest.packet_features(packets, stats), "packets")
    p_model = forest.fit_forest(p, "domain", row_id, policy.PACKET_FEATURES, n_trees=n_trees, sample_size=sample_size, seed=seed)
    p_scored = scratch_table(forest.score_trained(p, p_model, "domain", row_id, F.lit(policy.PACKET_FORMAT)), "scored")
    p_flagged = forest.attribute(filters.flagged(p_scored), p_model, "domain")

    bits = words.withColumn("data_bits_int", scalars.bits_to_int(F.col("data_bits")))
    w_stats = scratch_table(aggregates.label_baseline(bits, key="label_octal"), "stats")
    w = scratch_table(forest.word_features(words, w_stats, "label_octal"), "words")
    w_model = forest.fit_forest(w, "domain", row_id, policy.WORD_FEATURES, n_trees=n_trees, sample_size=sample_size, seed=seed)
    w_scored = scratch_table(forest.score_trained(w, w_model, "domain", row_id, F.lit(policy.WORD_FORMAT)), "scored")
    w_flagged = forest.attribute(filters.flagged(w_scored), w_model, "domain")

    shared = [row_id, "domain", "is_anomaly", "anomaly_score", "predicted_anomaly", "severity", "model_used"]
    scored = p_scored.select(*shared).unionByName(w_scored.select(*shared))
    why = [*shared, "shap_values", "top_features", "explanation_text"]
    explained = forest.explain_packets(p_flagged, stats).select(*why).unionByName(forest.explain_words(w_flagged, "label_octal").select(*why))
    return scored, explained


def score_table(df: DataFrame, model, stats: DataFrame, kind: str = policy.PACKET_FORMAT, label: str = "label_octal") -> DataFrame:
    """Score stored rows with a trained model. A group or label without statistics uses
    mean 0 and deviation 1; missing flags count as 0."""
    from evidence_spark.operators import forest

    if kind == policy.PACKET_FORMAT:
        flags = ["cross_domain_flag", "port_anomaly_flag", "protocol_anomaly_flag"]
        ready = df.withColumns({f: F.coalesce(scalars.pick(df, f, "bigint"), F.lit(0)) for f in flags})
        features = forest.packet_features(ready, stats)
    else:
        ready = df.withColumns(
            {
                "ssm_bits": F.coalesce(scalars.pick(df, "ssm_bits"), F.lit("11")),
                "data_bits": F.coalesce(scalars.pick(df, "data_bits"), F.lit("0" * 19)),
                "raw_hex": F.coalesce(scalars.pick(df, "raw_hex"), F.lit("0x0")),
            }
        )
        features = forest.word_features(ready, stats, label)
    return forest.score_forest(features, model, "domain", F.lit(kind))
