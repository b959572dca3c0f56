"""Periodic runs against plain search over all periods and starts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evidence_spark.llm import periodic
from llm_cases import DOCS, awkward


def plain_runs(x):
    """Every maximal stretch by comparing at every lag; the smallest period of a stretch counts."""
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences():
    r = random.Random(5)
    yield from ([], [1], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1] * 500, [1, 1, 2] * 90)
    for _ in range(150):
        x = []
        for _ in range(r.randint(1, 5)):
            block = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 31, 33, 64, 70]))]
            if r.random() < 0.4 and len(block) > 4:  # repetition within the period
                block = block[:2] * r.randint(2, 5) + block[2:]
            x += block * r.randint(1, 7) + block[: r.randrange(len(block))]
            x += [r.randrange(9) for _ in range(r.randint(0, 6))]
        yield x
    for _ in range(20):  # Fibonacci words hold the most repetitions
        a, b = [0], [0, 1]
        for _ in range(r.randint(3, 12)):
            a, b = b, b + a
        yield b


def test_runs_agree_with_every_lag():
    for x in sequences():
        assert periodic.runs_of(np.array(x, np.int64)) == plain_runs(x), x


@pytest.mark.parametrize("period", [7, 8, 9, 15, 16, 17, 100, 1000, 4097])
def test_long_periods(period):
    r = np.random.RandomState(period)
    block = r.randint(0, 50, period)
    x = np.concatenate([r.randint(100, 10**6, 333), np.tile(block, 4), r.randint(100, 10**6, 77)])
    assert periodic.runs_of(x) == [(333, 4 * period, period)]
    assert periodic.runs_of(x[: 333 + 4 * period - 1]) == []


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def expected(doc, text):
    words, h = words_of(text), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    known = {}
    runs = plain_runs([known.setdefault(w, len(known)) for w in words])
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = (None,) * 4
    if runs:
        top = max(m / q for _, m, q in runs)
        s, m, q = min(r for r in runs if abs(r[1] / r[2] - top) < 1e-12)
        best = (s, m, q, 1000 * m // q)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def digests(docs):
    return periodic.digests(periodic.periodic_runs(periodic.with_repeated_tails(docs)))


def test_documents_agree_with_plain_search(spark):
    rows = awkward(250) + [(10_000 + i, "so it went on " * i, "", 0, None, 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in digests(docs).collect()), key=str)
    want = sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 90
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[1])
    assert digests(docs.limit(0)).count() == 0


def test_rows_and_columns_stay(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    moved = periodic.with_repeated_tails(docs)
    assert moved.columns == docs.columns and moved.count() == docs.count()
    found = periodic.periodic_runs(spark.createDataFrame([(1, "a b c d a b c d a b c d a b c d e")], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 16, 4)] and found["collapsed"] == "a b c d e"
