"""SQL names for the shared rules, as SQL-bodied functions that Catalyst inlines."""

from __future__ import annotations

import ipaddress

from pyspark.sql import SparkSession

from evidence_spark import policy
from evidence_spark.functions.scalars import STRICT_IPV4


def _case(value: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else f"WHEN '{k}' THEN {float(v)}D" for k, v in table.items())
    return f"CASE {value} {arms} ELSE {default} END"


def register(spark: SparkSession) -> list[str]:
    """Create ``risk_score``, ``severity_band``, ``parity_valid``, ``ip_domain`` and
    ``node_slug`` as temporary SQL functions; returns their names."""
    bands = " ".join(f"WHEN score < {cut}D THEN '{label}'" for cut, label in policy.SEVERITY_CUTOFFS)
    weight = _case("upper(coalesce(nullif(severity, ''), 'ANOMALY'))", policy.SEVERITY_RISK, "0.6D")
    by_score = (
        "CASE WHEN coalesce(score, 0D) < 0 THEN least(1D, 0.55D + abs(score) * 2D) "
        "WHEN coalesce(score, 0D) <= 0.05D THEN greatest(0.25D, 0.55D - coalesce(score, 0D) * 4D) "
        "WHEN score <= 1 THEN score ELSE 0.25D END"
    )
    zones = []
    for name, cidr in policy.DOMAIN_NETWORKS.items():
        net = ipaddress.ip_network(cidr)
        zones.append(f"WHEN n BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)} THEN '{name}'")
    pattern = STRICT_IPV4.replace("\\", "\\\\")
    number = r"aggregate(split(address, '\\.'), 0L, (acc, p) -> acc * 256 + cast(p as bigint))"
    bodies = {
        "severity_band(score DOUBLE) RETURNS STRING": f"CASE WHEN score IS NULL THEN NULL {bands} ELSE 'NONE' END",
        "risk_score(score DOUBLE, severity STRING) RETURNS DOUBLE": f"floor(greatest({weight}, {by_score}) * 10000D + 0.5D) / 10000D",
        "parity_valid(word STRING) RETURNS INT": "bit_count(cast(conv(right(regexp_replace(word, '^0[xX]', ''), 8), 16, 10) AS BIGINT)) % 2",
        "ipv4_number(address STRING) RETURNS BIGINT": f"CASE WHEN address RLIKE '{pattern}' THEN {number} END",
        "network_of(n BIGINT) RETURNS STRING": f"CASE {' '.join(zones)} END",
        "ip_domain(address STRING) RETURNS STRING": "network_of(ipv4_number(address))",
        "node_slug(kind STRING, label STRING) RETURNS STRING": (
            r"concat(kind, '-', coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(nullif(label, ''), 'unknown'))), "
            r"'[^\\p{L}\\p{N}]+', '-'), '^-+|-+$', ''), ''), 'unknown'))"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
