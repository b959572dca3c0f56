"""Sinks and sources: a table goes out through a sink and comes back through its source."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from evidence_spark.functions import scalars, text
from evidence_spark.operators import aggregates, ordered
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.queries_sets import rounded
from evidence_spark.plans.registry import query
from evidence_spark.schemas import _struct
from evidence_spark.session import scratch_path
from evidence_spark.sources import files, sinks


@query("row_events", """SELECT 'CSV' AS source_type, '{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}' AS payload, '["c_custkey","c_mktsegment"]' AS columns FROM customer
    UNION ALL SELECT 'CSV', '{"s_name":"' || s_name || '","s_nationkey":"' || s_nationkey || '","s_suppkey":"' || s_suppkey || '"}', '["s_suppkey","s_name","s_nationkey"]' FROM supplier""")
def row_events(spark, sf):
    """Two kinds of CSV files below one folder, each read with its own header."""
    root = scratch_path(spark, "row-events")
    proxy.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).csv(f"{root}/customer")
    proxy.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(f"{root}/supplier")
    rows = files.read_raw_events(spark, root)
    return rows.select("source_type", F.col("payload").cast("string").alias("payload"), F.get_json_object("metadata_json", "$.columns").alias("columns"))


@query("ledger_roundtrip", "SELECT o_orderkey AS position, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS anchor_hash FROM orders")
def ledger_roundtrip(spark, sf):
    """Ledger records, nulls included, appended as JSON lines in two calls."""
    path = scratch_path(spark, "ledger")
    rows = proxy.table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("anchor_hash"))
    sinks.append_ledger(rows.filter("position % 2 = 0"), path)
    sinks.append_ledger(rows.filter("position % 2 = 1"), path)
    return files.read_ledger(spark, path, _struct(position=LongType(), anchor_hash=StringType()))


@query("table_roundtrip", "SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def table_roundtrip(spark, sf):
    """A table partitioned by one column and sorted inside its files."""
    path = scratch_path(spark, "table")
    sinks.write_table(proxy.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, ["l_returnflag"], ["l_linestatus"])
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("stats_roundtrip", with_ev("SELECT domain, round(avg(packet_size), 6) AS packet_size_mean FROM ev WHERE is_anomaly = 0 GROUP BY domain"))
def stats_roundtrip(spark, sf):
    path = scratch_path(spark, "stats")
    sinks.save_stats(aggregates.domain_baseline(proxy.evidence(spark, sf)), path)
    return rounded(sinks.load_stats(spark, path).select("domain", "packet_size_mean"), "packet_size_mean")


@query("explanations_roundtrip", with_ev("SELECT event_id, explanation FROM ev WHERE predicted_anomaly = 1"))
def explanations_roundtrip(spark, sf):
    path = scratch_path(spark, "explanations")
    rows = proxy.evidence(spark, sf).filter("predicted_anomaly = 1").select("event_id", "occurred_us", "explanation")
    sinks.write_explanations(rows, path, "occurred_us")
    return spark.read.schema("event_id bigint, explanation string").json(path)


@query("json_fields", "SELECT event_id, CASE WHEN starts_with(trim(props), '{') THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_fields(spark, sf):
    return proxy.table(spark, sf, "events").select("event_id", text.json_field(F.col("props"), "$.k").alias("k"))


@query("source_window_rate", with_ev("""SELECT sequence, src, count(*) OVER (PARTITION BY src ORDER BY occurred_us RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW)
    - (count(*) OVER (PARTITION BY src, occurred_us) - row_number() OVER (PARTITION BY src, occurred_us ORDER BY sequence)) AS frequency FROM ev"""))
def source_window_rate(spark, sf):
    """Rows of the same source in the last second."""
    return ordered.source_window_rate(proxy.evidence(spark, sf).select("sequence", "src", "occurred_us"), "src", "occurred_us", "sequence").drop("occurred_us")


@query("component_labels", with_ev("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN label_octal = '360' THEN 'ARINC 360' ELSE 'ARINC 206' END WHEN event_id % 3 = 1 THEN 'ARINC Bus' ELSE src END AS component,
    port IN (22, 23, 161, 502, 2404) AS sensitive FROM ev"""))
def component_labels(spark, sf):
    """Names of components as they are shown, and whether the port is a sensitive one."""
    named = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("label "), F.coalesce("label_octal", F.lit("206")))).when(F.col("event_id") % 3 == 1, "ARINC 429 bus").otherwise(F.col("src"))
    return proxy.evidence(spark, sf).select("event_id", scalars.component_label(named).alias("component"), scalars.sensitive_port(F.col("port")).alias("sensitive"))


@query("redacted_json", """SELECT event_id, '{"outer":{"k":' || json_extract_string(props, '$.k') || '},"list":[{"v":"[redacted]"},' || event_id || ']}' AS shown FROM events""")
def redacted_json(spark, sf):
    """Sensitive keys and values inside nested objects and lists."""
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"outer":{"api_key":"x","k":'), k, F.lit('},"list":[{"secret":1,"v":"'), F.md5(k), F.lit('"},'), F.col("event_id").cast("string"), F.lit("]}"))
    return proxy.table(spark, sf, "events").select("event_id", text.redact_json(nested).alias("shown"))


@query("chunk_roundtrip", """SELECT CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, count(*) AS line_ends,
    CAST(sum(1000003 * c_custkey + strlen(c_name)) AS BIGINT) AS checked FROM customer""")
def chunk_roundtrip(spark, sf):
    """Text files read back as binary chunks by byte range and put together again."""
    root = scratch_path(spark, "chunks")
    names = proxy.table(spark, sf, "customer").select(F.concat("c_name", F.lit("|"), "c_custkey").alias("value"))
    names.repartition(3).write.text(root)
    chunks = files.read_chunks(spark, root, 500, range_bytes=4000, glob="*.txt")
    whole = chunks.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("source_offset", "payload"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), "")
    lines = whole.select(F.explode(F.split(F.decode(F.unhex(text), "UTF-8"), "\n", -1)).alias("line")).filter("line <> ''")
    name, key = F.substring_index("line", "|", 1), F.substring_index("line", "|", -1).cast("bigint")
    size = F.octet_length(name)
    return lines.agg(F.sum(size + 1).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("line_ends"), F.sum(1000003 * key + size).cast("bigint").alias("checked"))
