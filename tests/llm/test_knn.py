"""Exact neighbours against brute force."""

import random

import numpy as np
import pytest

from evidence_spark.llm import knn
from evidence_spark.session import scratch_table

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(np.array(v, np.float32).astype(float) * 256)
    out = []
    for q in sorted(good):
        if q % 50 == 0:
            s = sorted((-int(good[q] @ v) if len(good[q]) and len(v) else 0, i) for i, v in good.items() if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def answer(spark, rows, k=5):
    data = scratch_table(knn.scaled(spark.createDataFrame(rows, SCHEMA).repartition(5)), "test-knn")
    return sorted(tuple(r) for r in knn.top_k(data, data.filter("vec_id % 50 = 0"), k).collect())


@pytest.mark.parametrize("blocks", [(8192, 512, 256), (100, 4, 3)])
def test_agrees_with_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("DATA_BLOCK", "QUERY_BLOCK", "QUERIES_A_PIVOT"), blocks):
        monkeypatch.setattr(knn, name, value)
    r = random.Random(1)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in r.choice(centres)], 1) for i in range(900)]
    rows += [(i, list(centres[0]), 1) for i in range(900, 1100)]  # many ties
    rows += [(2000, None, 1), (2050, [1.0] * 7 + [None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (None, centres[0], 1), (2200, [], 1), rows[0], rows[0]]
    assert answer(spark, rows) == brute(rows, 5)


def test_few_or_no_others(spark):
    assert answer(spark, [(0, [0.5, 0.25], 1), (1, [0.5, -0.3], 1)]) == [(0, 1, 1, 128 * 128 + 64 * -77)]
    assert answer(spark, [(0, [0.5, 0.25], 1)]) == [] and answer(spark, [(1, [0.5, 0.25], 1)]) == []
    assert answer(spark, [(0, [0.5], 1), (1, [], 1), (2, [0.5], 1), (50, [], 1)]) == [(0, 1, 2, 128 * 128), (0, 2, 1, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert answer(spark, [(0, [], 1), (1, [], 1)]) == [(0, 1, 1, 0)]
    empty = scratch_table(knn.scaled(spark.createDataFrame([], SCHEMA)), "test-knn")
    assert knn.top_k(empty, empty).count() == 0
