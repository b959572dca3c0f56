import hashlib

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import integrity

KEY = "k"


def raw(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("created_at"), F.lit("f.csv").alias("source_file"),
        F.lit("CSV").alias("source_type"), F.col("id").alias("source_offset"), F.lit('{"a":1}').alias("metadata_json"),
        F.concat(F.lit("payload "), F.col("id").cast("string")).cast("binary").alias("payload"),
    )


@pytest.fixture(scope="module")
def sealed(spark):
    return integrity.seal(raw(spark, 200), ["id"], segment_rows=50, key_id=KEY)


def failures(rows):
    checked = integrity.verify_rows(rows, KEY)
    return sorted(r.sequence for r in checked.filter(integrity.row_failed()).collect())


def test_intact_log_verifies(sealed):
    rows, summary = integrity.verify_chain(sealed.rows, KEY, sealed.segments)
    assert summary.first()["ok"] and summary.first()["checked_entries"] == 200


def test_single_segment_is_a_linear_chain(spark):
    one = integrity.seal(raw(spark, 5), ["id"], segment_rows=100, key_id=KEY)
    previous = "0" * 64
    for r in one.rows.orderBy("sequence").collect():
        assert r.previous_hash == previous
        assert r.entry_hash == hashlib.sha256(r.entry_material_json.encode()).hexdigest()
        previous = r.entry_hash
    assert one.head.first()["head_hash"] == previous


@pytest.mark.parametrize(
    "edit, expected",
    [
        (lambda d: d.filter("sequence <> 17"), [18]),
        (lambda d: d.withColumn("payload", F.when(F.col("sequence") == 41, F.lit("x").cast("binary")).otherwise(F.col("payload"))), [41]),
        (lambda d: d.withColumn("sequence", F.expr("case sequence when 90 then 91 when 91 then 90 else sequence end")), [90, 91, 92]),
        (lambda d: d.unionByName(d.filter("sequence = 120")), [120]),
        (lambda d: d.withColumn("source_file", F.when(F.col("sequence") == 3, F.lit("g.csv")).otherwise(F.col("source_file"))), [3]),
        (lambda d: d.filter("sequence <> 51"), [52]),
    ],
)
def test_edits_are_located(sealed, edit, expected):
    assert failures(edit(sealed.rows)) == expected


def test_cut_at_segment_end_is_found_by_segment_table(sealed):
    cut = sealed.rows.filter("sequence <> 100")
    assert failures(cut) == []
    assert not integrity.verify_chain(cut, KEY, sealed.segments)[1].first()["ok"]


def test_diff_and_restore(sealed):
    ledger = integrity.mirror(sealed.rows, "now", segment_rows=64)
    bad = sealed.rows.filter("sequence <> 5").withColumn("payload", F.when(F.col("sequence") == 7, F.lit("x").cast("binary")).otherwise(F.col("payload")))
    got = sorted((r.sequence, r.change) for r in integrity.diff_log(bad, ledger).collect())
    assert got == [(5, "deleted"), (7, "altered")]
    restored = integrity.restore(ledger)
    assert failures(restored) == [] and restored.count() == 200
    with pytest.raises(ValueError):
        integrity.restore(ledger.withColumn("recorded_at", F.when(F.col("position") == 9, "z").otherwise(F.col("recorded_at"))))


def test_legacy_entries_without_material(spark):
    previous, rows = "0" * 64, []
    for i in range(1, 4):
        payload = f"p{i}".encode()
        digest = hashlib.sha256(payload).hexdigest()
        text = f'{{"metadata":{{}},"payload_sha256":"{digest}","previous_hash":"{previous}"}}'
        entry = hashlib.sha256(text.encode()).hexdigest()
        rows.append((i, "t", "f", "CSV", i, "{}", bytearray(payload), digest, previous, entry, KEY, None))
        previous = entry
    schema = "sequence long, created_at string, source_file string, source_type string, source_offset long, metadata_json string, payload binary, payload_sha256 string, previous_hash string, entry_hash string, rsa_key_id string, entry_material_json string"
    log = spark.createDataFrame(rows, schema)
    assert failures(log) == []
    assert failures(log.withColumn("metadata_json", F.lit('{"b":2}'))) == [1, 2, 3]


def _root(leaves):
    if not leaves:
        return "0" * 64
    while len(leaves) > 1:
        leaves = leaves + leaves[-1:] if len(leaves) % 2 else leaves
        leaves = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(leaves[::2], leaves[1::2])]
    return leaves[0]


def test_merkle_roots_of_all_shapes(spark):
    sizes = [1, 2, 3, 5, 1023, 1024, 1025, 2048, 2049, 3073]
    rows = [(n, i, hashlib.sha256(f"{n}:{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, h string").repartition(7)
    got = {r.g: r.merkle_root for r in integrity.merkle_root(df, ["g"], "i", "h").collect()}
    assert got == {n: _root([hashlib.sha256(f"{n}:{i}".encode()).hexdigest() for i in range(n)]) for n in sizes}
    assert integrity.merkle_root(df.filter("false"), ["g"], "i", "h").count() == 0


def test_reachable_chain_skips_branches_and_stops_at_missing(spark):
    # 1-2-3 was written, then 3 again on top of 2; record b has no predecessor
    rows = [(1, 1, "a1", "0" * 64), (2, 2, "a2", "a1"), (3, 3, "old", "a2"), (4, 3, "a3", "a2"), (5, 4, "a4", "a3")]
    df = spark.createDataFrame(rows, "position long, sequence long, entry_hash string, previous_hash string").withColumn("segment_id", F.lit(0).cast("bigint"))
    ledger = df.select("position", F.struct("sequence", "segment_id", "entry_hash", "previous_hash").alias("row"))
    assert sorted(r.entry_hash for r in integrity.reachable_chain(ledger).collect()) == ["a1", "a2", "a3", "a4"]
    lost = ledger.filter("position <> 1")
    assert sorted(r.entry_hash for r in integrity.reachable_chain(lost).collect()) == ["a2", "a3", "a4"]


def test_gate(spark):
    def row(ok):
        return spark.createDataFrame([(ok,)], "ok boolean")

    checks = spark.createDataFrame([(True, True, True, True)], "batch_size_matches boolean, leaf_hashes_match boolean, merkle_root_matches boolean, ledger_matches boolean")
    data = spark.range(5)
    good = integrity.readiness(row(True), row(True), row(True), checks, 5, 1)
    bad = integrity.readiness(row(True), row(True), row(True), checks, 5, 0)
    assert integrity.gated(data, good).count() == 5 and integrity.gated(data, bad).count() == 0
    with pytest.raises(PermissionError):
        integrity.gated(data, bad, require=True)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_are_moved_once_and_without_hashed_texts(spark):
    whole = integrity.seal(raw(spark, 40_000).withColumn("id", F.col("id") % 39_000), ["id"], segment_rows=50, key_id=KEY)
    shown = plan(whole._chained)
    assert "FlatMapGroups" not in shown and shown.split("== Physical Plan ==")[1].count("Exchange ") == 1
    rows = whole.rows
    assert rows.agg(F.count("*"), F.countDistinct("sequence"), F.max("sequence")).first()[0:3] == (40_000, 40_000, 40_000)
    assert integrity.verify_chain(rows, KEY, whole.segments, keep=[])[1].first()["ok"]
    assert whole.segments.filter("entry_count <> 50").count() == 0


def test_segment_table_without_stored_rows(spark):
    one, two = (integrity.seal(raw(spark, 1000), ["id"], segment_rows=64, key_id=KEY) for _ in range(2))
    assert two.rows.count() == 1000
    assert sorted(one.segments.collect()) == sorted(two.segments.collect()) and "rows" not in one.__dict__
    assert one.head.first() == two.head.first()


def test_kept_columns_only_are_put_in_order(sealed):
    checked = integrity.verify_rows(sealed.rows, KEY, keep=["source_offset"])
    assert "payload" not in checked.columns and "source_offset" in checked.columns and checked.filter(integrity.row_failed()).isEmpty()
    ledger = integrity.mirror(sealed.rows, "now", segment_rows=64)
    assert integrity.verify_ledger(ledger, integrity.RECOVERY, "position", keep=[]).columns == ["position", "segment_id", "previous_ledger_hash", "ledger_hash", "failure"]


def test_restore_of_many_runs(sealed, monkeypatch):
    monkeypatch.setattr(integrity, "FEW_SPANS", 0)
    assert integrity.restore(integrity.mirror(sealed.rows, "now", segment_rows=64)).count() == 200
