"""All registered queries in one place."""

from evidence_spark.plans import queries_evidence, queries_graph, queries_integrity, queries_models, queries_rows, queries_sets, queries_sources, queries_streams, queries_text  # noqa: F401
from evidence_spark.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
