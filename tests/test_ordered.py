import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from evidence_spark.operators import ordered


def skewed(spark, n=600):
    """One key holds most of the rows, several hold one, times repeat."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 40}", rng.randrange(200) * 250_000, i) for i in range(n)]
    return spark.createDataFrame(rows, "key string, t bigint, id bigint").repartition(5)


def test_lag_equals_plain_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("t", "id")
    want = {(r.id, r.p) for r in df.withColumn("p", F.lag("t").over(w)).collect()}
    got = {(r.id, r.prev_t) for r in ordered.ordered_lag(df, ["key"], ["t", "id"], ["t"]).collect()}
    assert got == want


def test_lag_without_groups_and_empty_input(spark):
    df = skewed(spark)
    got = sorted((r.id, r.prev_id) for r in ordered.ordered_lag(df, [], ["id"], ["id"]).collect())
    assert got == [(0, None)] + [(i, i - 1) for i in range(1, 600)]
    assert ordered.ordered_lag(df.filter("false"), ["key"], ["t", "id"], ["t"]).count() == 0


def test_running_totals_and_sequence(spark):
    df = skewed(spark)
    got = [(r.id, r.s) for r in ordered.running_totals(df, ["id"], {"s": F.col("id")}).orderBy("id").collect()]
    assert got == [(i, i * (i + 1) // 2) for i in range(600)]
    numbered = ordered.global_sequence(df, ["t", "id"], "n", 10).orderBy("t", "id").collect()
    assert [r.n for r in numbered] == list(range(10, 610))


def test_rolling_count_with_ties(spark):
    df = skewed(spark)
    got = {r.id: r.frequency for r in ordered.rolling_count(df, ["key"], "t", "id", 1).collect()}
    rows = sorted((r.key, r.t, r.id) for r in df.collect())
    for i, (key, t, row_id) in enumerate(rows):
        want = sum(1 for k, u, _ in rows[: i + 1] if k == key and t - 1_000_000 < u <= t)
        assert got[row_id] == want


def test_rolling_count_excludes_exactly_one_second(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1_000_000, 2), ("a", 1_000_000, 3)], "key string, t bigint, id bigint")
    got = {r.id: r.frequency for r in ordered.rolling_count(df, ["key"], "t", "id", 1).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_arrival_rate_edges(spark):
    rows = [("a", 0, 1), ("a", 500_000, 2), ("a", 500_000, 3), ("a", 2_500_000, 4), ("b", 7, 5)]
    df = spark.createDataFrame(rows, "d string, t bigint, id bigint")
    got = {r.id: r.frequency for r in ordered.arrival_rate(df, "d", "t", "id").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 10000.0, 4: 0.5, 5: None}


def test_percentile_matches_numpy(spark):
    df = skewed(spark)
    for q in (0.0, 0.013, 0.5, 0.97, 1.0):
        got = {r.key: r.p for r in ordered.exact_percentile(df, ["key"], "t", q, "p").collect()}
        values = {}
        for r in df.collect():
            values.setdefault(r.key, []).append(r.t)
        for key, v in values.items():
            assert abs(got[key] - np.percentile(v, 100 * q)) < 1e-6


def test_gaps(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (4,), (7,)], "sequence bigint").withColumn("tie", F.monotonically_increasing_id())
    got = [(r.sequence, r.expected_sequence) for r in ordered.sequence_gaps(df, tie="tie").orderBy("sequence", "tie").collect()]
    assert got == [(4, 3), (4, 5), (7, 5)]


def test_plans_have_no_single_task_stage_over_data(spark):
    df = skewed(spark)
    for out in (ordered.ordered_lag(df, ["key"], ["t", "id"], ["t"]), ordered.global_sequence(df, ["id"], "n"), ordered.rolling_count(df, ["key"], "t", "id", 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_whole_ranges_keep_ties_together(spark):
    # 12 rows of each number, so most cuts at multiples of 50 would part equal rows
    df = spark.range(3000).select((F.col("id") % 250).alias("k"), F.when(F.col("id") % 250 > 3, F.col("id") % 250).alias("t")).repartition(5)
    cut = ordered.whole_ranges(df, ["t", "k"], 50, least_rows=100)
    sizes = {r._range: r["count"] for r in df.withColumn("_range", cut.column).groupBy("_range").count().collect()}
    assert [sizes[i] for i in range(len(cut.sizes))] == cut.sizes and len(cut.sizes) > 1
    assert all(s % 50 == 0 and s % 12 == 0 for s in cut.starts)


def test_running_totals_start_behind_nulls(spark):
    df = spark.createDataFrame([(i, None if i < 3 else 1) for i in range(100)], "id int, m int")
    got = {r.id: r.s for r in ordered.running_totals(df, ["id"], {"s": F.col("m")}).collect()}
    assert got[99] == 97 and got[3] == 1
