import json
import os

import pytest
from pyspark.sql import functions as F

from evidence_spark import schemas

from evidence_spark.streaming import keyed, live


def records(n, start=0, verdict=True, payload=None):
    out = []
    for i in range(start, start + n):
        body = payload or json.dumps({"domain": "cabin", "timestamp": f"2024-01-01T00:00:{i % 60:02d}"})
        out.append({"source_file": "live://a", "source_type": "LIVE", "source_offset": i, "payload": body,
                    "verdict": json.dumps({"anomaly_score": -0.1, "predicted_anomaly": 1, "severity": "HIGH"}) if verdict else None,
                    "scenario": "s", "recorded_at": f"2024-01-01T00:00:{i % 60:02d}"})
    return out


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def stream(spark, path):
    return spark.readStream.schema(schemas.LIVE_RECORD).option("maxFilesPerTrigger", 1).json(str(path))


def test_intake_seals_batches_and_verifies(spark, tmp_path):
    write(tmp_path / "in", "1.json", records(7))
    root, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.live_intake(stream(spark, tmp_path / "in"), root, state, "k", 4)
    write(tmp_path / "in", "2.json", records(5, 7))
    live.live_intake(stream(spark, tmp_path / "in"), root, state, "k", 4)
    log = spark.read.parquet(f"{root}/log")
    assert sorted(r.sequence for r in log.collect()) == list(range(1, 13))
    assert sorted(r.evidence_id for r in spark.read.parquet(f"{root}/evidence").collect()) == list(range(1, 13))
    cps = spark.read.parquet(f"{root}/checkpoints").orderBy("checkpoint_id").collect()
    assert [c.batch_size for c in cps] == [7, 5] and cps[1].previous_ledger_hash == cps[0].ledger_hash
    assert all(r.ok for r in live.verify_new_batches(spark, root, "k").collect())
    heads = spark.read.parquet(f"{root}/heads").orderBy("batch_id").collect()
    second = log.filter("batch_id = 1").orderBy("sequence").first()
    assert second.previous_hash == heads[0].head_hash
    before = {(r.sequence, r.entry_hash) for r in log.collect()}
    # the same batch again replaces itself
    batch = spark.createDataFrame([tuple(r.values()) for r in records(5, 7)], schemas.LIVE_RECORD)
    assert live.intake_batch(batch, 1, root, "k", 4) == "sealed"
    again = spark.read.parquet(f"{root}/log")
    assert again.count() == 12
    assert {(r.sequence, r.entry_hash) for r in again.collect()} == before
    now = 1704067206000000 + 5_000_000
    assert live.intake_liveness(spark.read.parquet(f"{root}/heads"), now + 10).first()["active"]
    assert not live.intake_liveness(spark.read.parquet(f"{root}/heads"), now + 60_000_000).first()["active"]


@pytest.mark.parametrize("rows, reason", [(records(2) + records(1, 2, verdict=False), "scored and raw records mixed"), (records(2) + records(1, 2, payload="not json"), "unreadable payload")])
def test_bad_batches_are_rejected_whole(spark, tmp_path, rows, reason):
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.LIVE_RECORD)
    assert live.intake_batch(batch, 0, str(tmp_path / "out")) == reason
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 3
    assert live.read_batches(spark, str(tmp_path / "out/log")) is None


def test_rates_carry_over_batches_and_late_rows(spark, tmp_path):
    root = str(tmp_path / "r")
    schema = "domain string, occurred_us long, sequence long"
    first = spark.createDataFrame([("a", 0, 1), ("a", 500_000, 2), ("b", 100, 3)], schema)
    second = spark.createDataFrame([("a", 1_000_000, 4), ("a", 400_000, 5), ("b", 1_000_100, 6)], schema)
    live.rate_batch(first, 0, root, "domain", "occurred_us", "sequence")
    live.rate_batch(second, 1, root, "domain", "occurred_us", "sequence")
    live.rate_batch(second, 1, root, "domain", "occurred_us", "sequence")
    got = {r.sequence: (r.frequency, r.late) for r in spark.read.parquet(f"{root}/rates").collect()}
    assert got == {1: (2.0, False), 2: (2.0, False), 3: (None, False), 4: (2.0, False), 5: (None, True), 6: (1.0, False)}


def test_trend_drops_rows_behind_the_watermark(spark, tmp_path):
    schema = "at timestamp, severity string, predicted_anomaly int"
    rows = [[{"at": "2024-01-01T00:30:00Z", "severity": "HIGH", "predicted_anomaly": 1}], [{"at": "2024-01-01T01:00:00Z", "severity": "LOW", "predicted_anomaly": 1}],
            [{"at": "2024-01-01T00:01:00Z", "severity": "HIGH", "predicted_anomaly": 1}, {"at": "2024-01-01T01:00:30Z", "severity": "MEDIUM", "predicted_anomaly": 1}]]
    for i, part in enumerate(rows):
        write(tmp_path / "in", f"{i}.json", part)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    from evidence_spark.sources.sinks import write_batch

    live.run_available(live.stream_severity_trend(source, "at"), lambda b, i: write_batch(b, out, i), str(tmp_path / "st"), "update")
    got = {(r.high, r.medium, r.low) for r in live.latest_by_key(spark.read.parquet(out), ["bucket_us"]).collect()}
    assert got == {(1, 0, 0), (0, 1, 1)}


def test_score_stream_matches_batch(spark, tmp_path, sf):
    from evidence_spark import policy
    from evidence_spark.functions import scalars
    from evidence_spark.operators import aggregates, forest
    from evidence_spark.plans import proxy

    keep = ["event_id", "data_format", "domain", "src", "dst", "port", "protocol", "packet_size", "frequency", "is_anomaly"]
    packets = proxy.evidence(spark, sf).filter("data_format = 'PCAP'").select(*keep)
    flagged = scalars.security_flags(packets)
    stats = aggregates.domain_baseline(packets)
    model = forest.fit_forest(forest.packet_features(flagged, stats), "domain", "event_id", policy.PACKET_FEATURES, n_trees=10, sample_size=64)
    source = proxy.evidence_of(proxy.event_stream(spark, sf)).filter("data_format = 'PCAP'").select(*keep)
    live.run_available(live.score_stream(source, model, stats), lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "s")), str(tmp_path / "st"))
    want = forest.score_forest(forest.packet_features(flagged, stats), model, "domain", F.lit("PCAP"))
    got = {r.event_id: round(r.anomaly_score, 9) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {r.event_id: round(r.anomaly_score, 9) for r in want.collect()} and len(got) > 100


def gap_stream(spark, path):
    return spark.readStream.schema("domain string, occurred_us long, sequence long").option("maxFilesPerTrigger", 1).json(str(path))


def test_keyed_gaps_are_the_same_with_and_without_a_restart(spark, tmp_path):
    second = 1_000_000
    parts = [
        [("a", 0, 1), ("a", second // 2, 2), ("b", 100, 3), (None, 5, 4), ("a", None, 5)],
        [("a", second // 2, 6), ("a", second // 4, 7), ("b", 5 * second + 100, 8)],
        [("a", 3 * second, 9), (None, second + 5, 10), ("a", 3 * second, 11), ("b", 5 * second + 50, 12)],
    ]

    def rates(name, stops):
        folder, out, state = tmp_path / name, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")
        for i, part in enumerate(parts):
            write(folder, f"{i}.json", [dict(zip(("domain", "occurred_us", "sequence"), row)) for row in part])
            os.utime(folder / f"{i}.json", (i, 1_700_000_000 + 10 * i))  # files are taken by age
            if i in stops:
                keyed.collect_gaps(keyed.stream_gaps(gap_stream(spark, folder), "domain", "occurred_us", "sequence", second), out, state)
        done = keyed.complete_rates(spark.read.parquet(out), "domain", "occurred_us", "sequence")
        return {r.sequence: (r.frequency, r.late) for r in done.collect()}

    got = rates("through", {2})
    assert got == rates("stopped", {0, 1, 2})
    assert got == {
        1: (5001.0, False), 2: (2.0, False), 6: (10000.0, False), 7: (None, True), 9: (0.4, False), 11: (10000.0, False), 5: (5001.0, False),
        3: (0.2, False), 8: (0.2, False), 12: (None, True), 4: (1.0, False), 10: (1.0, False),
    }


def test_keyed_gaps_of_an_empty_stream(spark, tmp_path):
    write(tmp_path / "in", "0.json", [])
    out = str(tmp_path / "out")
    keyed.collect_gaps(keyed.stream_gaps(gap_stream(spark, tmp_path / "in"), "domain", "occurred_us", "sequence"), out, str(tmp_path / "st"))
    table = spark.createDataFrame([], "domain string, occurred_us long, sequence long, slot long, gap_us long, late boolean, head boolean")
    assert keyed.complete_rates(table, "domain", "occurred_us", "sequence").isEmpty()


def test_batches_are_verified_together_and_name_the_bad_one(spark, tmp_path):
    root, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        write(tmp_path / "in", f"{i}.json", records(6, 6 * i))
        live.live_intake(stream(spark, tmp_path / "in"), root, state, "k", 4)
    one = tmp_path / "out/log/batch_id=1"
    changed = spark.read.parquet(str(one)).withColumn("payload", F.when(F.col("sequence") == 9, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("payload")))
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(str(one))
    two = spark.read.parquet(str(tmp_path / "out/log/batch_id=2"))
    kept = two.filter("sequence != 18").collect()
    spark.createDataFrame(kept, two.schema).write.mode("overwrite").parquet(str(tmp_path / "out/log/batch_id=2"))
    got = {r.batch_id: (r.ok, r.checked_entries, r.first_failure, r.segments_ok) for r in live.verify_new_batches(spark, root, "k").collect()}
    assert got == {0: (True, 6, None, True), 1: (False, 3, 9, True), 2: (False, 5, None, False)}
    assert live.verify_new_batches(spark, root, "k").count() == 3
