"""Repeated byte strings against plain enumeration of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import suffix_dedup

SCHEMA = "doc_id long, text string, k1 string, row int"


def expected(texts, threshold):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + threshold] for b in bodies for i in range(len(b) - threshold + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - threshold + 1):
            if count[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, threshold):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(threshold // 3) for _ in range(4)]
    texts = [None, "", "a", "ab" * threshold, "z" * (3 * threshold), "z" * threshold, prose(threshold)]
    for _ in range(40):
        parts = [prose(r.randint(0, threshold))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(threshold // 2, 2 * threshold)], prose(r.randint(0, 20))]
        texts.append("".join(parts))
    base = prose(threshold)
    for _ in range(12):  # near copies
        at = r.randint(0, len(base) - 2)
        texts.append(base[:at] + r.choice("xyz") + base[at + 1 :])
    return texts + [texts[8], texts[8], base, base[1:], base[:-1]]


@pytest.mark.parametrize("threshold,seed", [(400, 1), (9, 4)])
def test_agrees_with_enumeration(spark, threshold, seed):
    texts = corpus(seed, threshold)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(docs, threshold).collect()}
    assert got == dict(enumerate(expected(texts, threshold)))


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    docs = spark.createDataFrame([(None, text, "x", 0), (1, text, "y", 1), (1, text, "y", 1), (2, None, None, 2)], SCHEMA)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.removed(docs).collect())
    assert got == [("1", 500), ("1", 500), ("2", 0), ("None", 500)]
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
    kept = suffix_dedup.dedup_passages(docs)
    assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} == {"", None}


def test_byte_counts(spark):
    texts = [None, "", "aé", "é" * 300, "x" * 450, "x" * 450]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removed(docs).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (3, 0), 3: (600, 600), 4: (450, 450), 5: (450, 450)}


def test_query_has_the_contract_columns(spark, sf):
    from evidence_spark.llm.queries import QUERIES

    result = QUERIES["op1_suffix_dedup"](spark, sf)
    assert result.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_bytes"] for r in result.collect()} == sizes


def test_whole_text_beyond_one_segment(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 64)
    r = random.Random(5)
    text = "".join(r.choice("ab ") for _ in range(3000))
    g = suffix_dedup.Geometry(20)
    anchors, first, last = suffix_dedup.blocks(text.encode(), g)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1 << 20)
    whole = suffix_dedup.blocks(text.encode(), g)
    assert all((x == y).all() for x, y in zip((anchors, first, last), whole)) and len(set(anchors.tolist())) == len(anchors)


def test_cut_characters_go(spark):
    passage = "é" * 250
    docs = spark.createDataFrame([(1, "aé" + passage), (2, "b" + passage + "c")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup_passages(docs).select("doc_id", "text").collect()}
    assert got == {1: "a", 2: "bc"} and isinstance(docs.select(F.lit(1)).first()[0], int)
