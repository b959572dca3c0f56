import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from evidence_spark.operators import aggregates, forest

COLS = ["x", "y"]


def data(spark, parts):
    rng = np.random.default_rng(1)
    rows = [("g%d" % (i % 2), i, float(rng.normal()), float(rng.normal()), 0) for i in range(600)]
    rows += [("g%d" % (i % 2), 600 + i, 9.0 + i, -9.0, 1) for i in range(12)]
    return spark.createDataFrame(rows, "grp string, id long, x double, y double, is_anomaly int").repartition(parts)


def test_model_does_not_depend_on_partitions_and_finds_outliers(spark):
    def run(parts):
        df = data(spark, parts)
        model = forest.fit_forest(df, "grp", "id", COLS, n_trees=30, sample_size=64)
        return df, forest.score_forest(df, model, "grp", F.lit("m"))

    _, a = run(3)
    _, b = run(7)
    first = {r.id: round(r.anomaly_score, 9) for r in a.collect()}
    assert first == {r.id: round(r.anomaly_score, 9) for r in b.collect()}
    table = aggregates.evaluate(a, []).first()
    assert table["detection_rate"] > 0.9 and table["false_positive_rate"] < 0.01


def test_attribution_equals_subset_enumeration(spark):
    df = data(spark, 2)
    trees = forest.grow_trees(forest.sample_rows(df, "grp", "id", 3, 16, 7), "grp", COLS, 7, 16, 0.01).toPandas()
    pack = forest._pack(trees)["g0"]
    x = np.array([[0.1, 0.2], [9.0, -9.0], [-1.0, 1.5]])

    def expected(root, row, present):
        """Tree value when only the listed features are known."""
        def walk(node):
            if pack["is_leaf"][node]:
                return pack["value"][node]
            left, right = pack["children"][2 * node], pack["children"][2 * node + 1]
            f = pack["feature"][node]
            if f in present:
                return walk(left if row[f] <= pack["threshold"][node] else right)
            n = pack["n_rows"]
            return (n[left] * walk(left) + n[right] * walk(right)) / n[node]
        return walk(root)

    got = forest._attributions(pack, x)
    for i, row in enumerate(x):
        for j in range(2):
            want = 0.0
            for root in pack["roots"]:
                others = [k for k in range(2) if k != j]
                for size in range(len(others) + 1):
                    for s in itertools.combinations(others, size):
                        w = math.factorial(size) * math.factorial(1 - size) / math.factorial(2)
                        want += w * (expected(root, row, {*s, j}) - expected(root, row, set(s)))
            assert abs(got[i, j] - want / len(pack["roots"])) < 1e-9


def test_explanations_need_top_two_and_negative(spark):
    rows = [("cabin", 900, 10, 22, "ICMP", ["packet_size", "port_anomaly_flag"], {"packet_size": -1.0, "port_anomaly_flag": 0.5}), ("cabin", 5, 5, 80, "TCP", ["frequency"], {"frequency": 0.1})]
    df = spark.createDataFrame(rows, "domain string, packet_size int, frequency int, port int, protocol string, top_features array<string>, shap_values map<string,double>")
    stats = spark.createDataFrame([("cabin", 100.4, 9.6)], "domain string, packet_size_mean double, frequency_mean double")
    got = [r.explanation_text for r in forest.explain_packets(df, stats).orderBy(F.desc("packet_size")).collect()]
    assert got == ["Packet of 900 bytes, where 100 is usual for the domain.", "Packet traffic deviates from its baseline."]


def test_sample_is_bounded_per_tree(spark):
    sizes = forest.sample_rows(data(spark, 4), "grp", "id", 5, 32, 1).groupBy("grp", "tree").count().collect()
    assert len(sizes) == 10 and all(r["count"] == 32 for r in sizes)


def test_pieces_of_the_model_give_the_same_rows(spark, monkeypatch):
    df = data(spark, 3)
    model = forest.fit_forest(df, "grp", "id", COLS, n_trees=5, sample_size=16)
    more = df.unionByName(spark.createDataFrame([("new", 9000, 0.0, 0.0, 0), (None, 9001, 0.0, 0.0, 0)], df.schema))
    whole = sorted((r.id, round(r._phi, 9)) for r in attributed(more, model).collect())
    monkeypatch.setattr(forest, "MAX_MODEL_ROWS", 1)
    assert whole == sorted((r.id, round(r._phi, 9)) for r in attributed(more, model).collect()) and len(whole) == 614
    known = forest.score_trained(df, model, "grp", "id", F.lit("m"))
    again = forest.score_forest(df, model, "grp", F.lit("m"))
    assert {r.id: round(r.anomaly_score, 9) for r in known.collect()} == {r.id: round(r.anomaly_score, 9) for r in again.collect()}


def attributed(df, model):
    return forest.attribute(df, model, "grp").select("id", F.col("shap_values")["x"].alias("_phi"))
