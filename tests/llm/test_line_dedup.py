"""Frequent lines against plain counting, over any split into batches."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import line_dedup
from llm_cases import DOCS, awkward

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(rows, least):
    found = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (key(x) and found[key(x)] >= least)]
        out.append((str(r[0]), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least,batches,fanout", [(10, 3, 2), (2, 5, 2), (4, 1, 2)])
def test_agrees_with_counting(spark, least, batches, fanout):
    rows = awkward()
    done = line_dedup.without_frequent_lines(spark.createDataFrame(rows, DOCS), least, batches=batches, fanout=fanout)
    got = done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got.collect()) == expected(rows, least)


def test_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    done = line_dedup.dedup_lines(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
