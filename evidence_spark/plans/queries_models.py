"""Isolation forests over the evidence view (rows-only: training is randomised)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import scalars
from evidence_spark.operators import aggregates
from evidence_spark.plans import proxy
from evidence_spark.plans.detection import detect
from evidence_spark.plans.registry import query


def _inputs(spark, sf):
    ev = scalars.security_flags(proxy.evidence(spark, sf)).drop("severity", "anomaly_score", "predicted_anomaly", "top_features", "explanation")
    return ev.filter(F.col("data_format") == "PCAP"), ev.filter(F.col("data_format") == "ARINC429")


@query("forest_scores")
def forest_scores(spark, sf):
    """Scores of all packet and word rows from forests trained on all of them."""
    scored, _ = detect(*_inputs(spark, sf), "event_id")
    return scored


@query("forest_evaluation")
def forest_evaluation(spark, sf):
    """Detection metrics per domain against the labels."""
    scored, _ = detect(*_inputs(spark, sf), "event_id")
    return aggregates.evaluate(scored, ["domain"])


@query("explanations")
def explanations(spark, sf):
    """Attributions and sentences of every flagged row, by time of the event."""
    _, explained = detect(*_inputs(spark, sf), "event_id")
    return explained.withColumn("shap_values", F.to_json("shap_values"))
