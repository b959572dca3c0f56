"""Quality and toxicity: accuracy on rows that were not learned from, and awkward rows."""

import numpy as np

from evidence_spark.llm import quality, toxicity
from llm_cases import DOCS, awkward

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    scored = quality.classify(docs, labels)
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1 OR (score >= 0.5) <> (predicted = 1)").count() == 0
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert quality.accepted(docs, labels).columns == docs.columns


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = tables(spark)
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs, wrong).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_isotonic_pools_violators():
    at, share = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert share.tolist() == [0, 0.5, 1] and np.allclose(at, [0.1, 0.25, 0.4])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    graded = toxicity.grade(docs, labels)
    assert graded.count() == docs.count() and graded.filter("severity < 0 OR severity > 3").count() == 0
    held = graded.filter("crc32(CAST(doc_id AS STRING)) % 3 = 1").join(labels.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert (held.toxic.astype(int) == held.y).mean() > 0.9 and held[held.y == 0].toxic.mean() < 0.02


def test_awkward_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(awkward(10), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        assert quality.classify(docs, labels).count() == docs.count()
        assert toxicity.grade(docs, labels).count() == docs.count()
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), few).count() == 0 and toxicity.grade(docs.limit(0), few).count() == 0
