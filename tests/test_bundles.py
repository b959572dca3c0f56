from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators import aggregates, evidence, forest, graph, integrity
from evidence_spark.plans import detection, proxy
from evidence_spark.sources import sinks


def test_panel_snapshot_and_security_events(spark, tmp_path):
    src = spark.range(1, 21).select(
        F.col("id"), F.lit("2024-01-01T00:00:00").alias("created_at"), F.lit("a.csv").alias("source_file"), F.lit("CSV").alias("source_type"),
        F.col("id").alias("source_offset"), F.lit("{}").alias("metadata_json"), F.col("id").cast("string").cast("binary").alias("payload"),
    )
    extra = evidence.security_event(
        spark.range(1).select(F.lit(99).cast("bigint").alias("source_offset")), F.lit("tamper_attempt_blocked"), F.lit("HIGH"), F.lit("2024-01-02T00:00:00"), F.lit('{"operation":"update"}')
    )
    sealed = integrity.seal(src.unionByName(extra.withColumn("id", F.lit(21).cast("bigint"))), ["id"], key_id="k")
    rows, summary = integrity.verify_chain(sealed.rows, "k", sealed.segments)
    anchors = integrity.anchor(sealed.rows, 1, "now", "k")
    kept = integrity.ledger_summary(integrity.verify_ledger(integrity.mirror(sealed.rows, "now"), integrity.RECOVERY, "position"), "position")
    none = spark.createDataFrame([], "batch_size_matches boolean, leaf_hashes_match boolean, merkle_root_matches boolean, ledger_matches boolean")
    ready = integrity.readiness(summary, kept, kept, none, 0, 0)
    panel = integrity.integrity_panel(sealed.rows, summary, anchors, kept, ready)
    assert panel["status"].first()["status"] == "verified" and panel["readiness"].first()["trusted"]
    evidence.snapshot(panel, str(tmp_path / "snap"), "s1")
    assert spark.read.parquet(str(tmp_path / "snap/snapshot_id=s1/source_summary")).count() == 2
    from evidence_spark.operators import feeds

    shown = feeds.security_events_view(sealed.rows).first()
    assert (shown.event, shown.severity, shown.details_json) == ("tamper_attempt_blocked", "HIGH", '{"operation":"update"}')


def test_growth_without_entries_and_most_central(spark):
    from evidence_spark.operators import feeds

    empty = spark.createDataFrame([], "sequence long, source_type string, source_file string, offset_label string, source_offset long, created_at string")
    sources = spark.createDataFrame([("x/a.csv", "CSV", 5, "t1", 1, 5)], "source_file string, source_type string, records long, last_seen string, first_sequence long, last_sequence long")
    anchors = spark.createDataFrame([(1, 5, "t2")], "position long, sequence long, created_at string")
    head = spark.createDataFrame([(5,)], "sequence long")
    got = [r.type for r in feeds.chain_growth(empty, sources, anchors, head).collect()]
    assert got == ["Head", "Anchor", "CSV"]
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "id string, centrality double")
    assert graph.most_central(nodes, scores).first()["label"] == "B"


def test_score_table_handles_unknown_labels(spark, sf, tmp_path):
    words = proxy.evidence(spark, sf).filter("data_format = 'ARINC429'").drop("severity", "anomaly_score", "predicted_anomaly")
    bits = words.withColumn("data_bits_int", scalars.bits_to_int(F.col("data_bits")))
    stats = aggregates.label_baseline(bits, key="label_octal")
    sinks.save_stats(stats, str(tmp_path / "stats"))
    stats = sinks.load_stats(spark, str(tmp_path / "stats"))
    model = forest.fit_forest(forest.word_features(words, stats, "label_octal"), "domain", "event_id", policy.WORD_FEATURES, n_trees=10, sample_size=64)
    odd = words.limit(5).withColumn("label_octal", F.lit("777")).drop("ssm_bits")
    scored = detection.score_table(odd, model, stats, policy.WORD_FORMAT)
    assert scored.count() == 5 and scored.filter("anomaly_score is null").count() == 0


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 2.0)], "domain string, sequence int, timestamp double")
    sinks.write_table(df, str(tmp_path / "t"), ["domain"], ["sequence"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("domain = 'a'").count() == 1
    sinks.write_explanations(df, str(tmp_path / "e"))
    assert [r.sequence for r in spark.read.json(str(tmp_path / "e")).orderBy("timestamp").collect()] == [2, 1]


def test_events_are_spread_before_they_grow(spark, tmp_path):
    from evidence_spark.plans import proxy

    spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' as ts, id as user_id, 'click' as event_type, 1.5D as value, '{\"k\": 3}' as props from range(50)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = proxy.evidence(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 50
