"""Toxicity as a severity grade by cumulative-link ordinal regression on sparse text features.

P(grade > j) = 1 / (1 + exp(cut_j - w.x)) with one weight vector for all ordered cuts. The
labels say toxic or not; of the toxic ones, how many of the most telling features a text
holds gives the grades 1 to 3. The severity is the expected grade.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.llm.quality import held_out
from evidence_spark.session import scratch_table

#: Most labelled texts learned from (those with the smallest hashes of their id), most features.
SAMPLE, VOCABULARY = 20_000, 4096
#: Bytes of a word's beginnings that count as features beside the word.
PREFIXES = (5, 6, 7, 8)
#: Telling features a toxic text needs for the grades 2 and 3.
GRADES = (6, 15)
LEAST_TEXTS = 3
_SPACES = bytes(32 if not (97 <= c <= 122 or c >= 128) else c for c in range(256))
_CACHE = 400_000


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case; everything else of ASCII separates them."""
    return text.lower().encode().translate(_SPACES).split()


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def counted(words: list[bytes], known: dict[bytes, list[int]], vocabulary: dict[bytes, int]) -> dict[int, float]:
    """1 + log(occurrences) of the features of the vocabulary; ``known`` remembers words."""
    if len(known) > _CACHE:
        known.clear()
    hits: dict[int, int] = {}
    for word in words:
        mine = known.get(word)
        if mine is None:
            mine = known[word] = [vocabulary[f] for f in features_of(word) if f in vocabulary]
        for f in mine:
            hits[f] = hits.get(f, 0) + 1
    return {f: 1 + float(np.log(n)) for f, n in hits.items()}


def _training(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, y) of the labelled documents learned from, ``sample`` at most."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = scratch_table(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxicity-sample")
    texts = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return join_checked(texts, chosen, ["doc_id"], "inner").select("text", "y")


def _vocabulary(train: DataFrame, size: int) -> list[tuple[bytes, float]]:
    """The features that differ most between the two labels by document frequency, with their
    weighted log ratios."""

    def rows(c):
        for text, y in zip(c["text"], c["y"]):
            for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                yield f, y

    seen = map_rows(train, "f binary, y int", rows, ["f", "y"], [pa.binary(), pa.int32()])
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    counts = seen.groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") + F.col("b") >= LEAST_TEXTS)
    ratio = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    told = counts.withColumn("z", ratio * F.sqrt(F.greatest("a", F.col("b") * n1 / n0)))
    return [(bytes(r["f"]), r["z"]) for r in told.orderBy(F.abs("z").desc(), "f").limit(size).collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, size: int = VOCABULARY, penalty: float = 1e-3) -> dict | None:
    """Weights and cuts from a bounded sample of the labelled documents; None if they do not
    hold both labels. Rows whose crc32(doc_id) mod 3 is 1 are never learned from."""
    train = scratch_table(_training(docs, labels, label, sample), "toxicity-train")
    if train.select("y").distinct().count() < 2:
        return None
    told = _vocabulary(train, size)
    vocabulary = {f: i for i, (f, _) in enumerate(told)}
    telling = {i for i, (_, z) in enumerate(told) if z > 0 and i < size // 8}

    def rows(c):
        for text, y in zip(c["text"], c["y"]):
            x = counted(words_of(text), {}, vocabulary)
            grade = 0 if not y else 1 + sum(len(telling & x.keys()) >= g for g in GRADES)
            yield list(x.keys()), list(x.values()), grade

    sparse = map_rows(train, "i array<int>, v array<double>, grade int", rows, ["i", "v", "grade"], [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32()]).collect()
    at = np.repeat(np.arange(len(sparse)), [len(r["i"]) for r in sparse])
    column = np.concatenate([np.array(r["i"], np.int64) for r in sparse])
    value = np.concatenate([np.array(r["v"], float) for r in sparse])
    grade = np.array([r["grade"] for r in sparse])
    weights, cuts = _descend(at, column, value, grade, len(told), penalty)
    return {"vocabulary": vocabulary, "weights": weights, "cuts": cuts}


def _descend(at, column, value, grade, width: int, penalty: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; the cuts stay ordered as a first one and positive steps."""
    n, top = len(grade), len(GRADES) + 1
    theta = np.zeros(width + top)
    theta[width:] = [2.0, 0.0, 0.0][:top]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, steps = theta[:width], np.exp(np.clip(theta[width + 1 :], -8, 8))
        cuts = theta[width] + np.concatenate([[0], np.cumsum(steps)])
        f = np.bincount(at, w[column] * value, n)
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -40, 40)))  # P(grade > j)
        edges = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        p = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        d_f = -(up - down) / n
        d_cut = np.zeros(top)
        for j in range(top):
            d_cut[j] = (up[grade == j + 1].sum() - down[grade == j].sum()) / n
        grad = np.concatenate([np.bincount(column, d_f[at] * value, width) + penalty * w / np.sqrt(n), [d_cut.sum()], [d_cut[j + 1 :].sum() * steps[j] for j in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:width], theta[width] + np.concatenate([[0], np.cumsum(np.exp(np.clip(theta[width + 1 :], -8, 8)))])


def grade(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(k1, k2, doc_id, severity, p_toxic, toxic), one row for each row of ``docs``: the expected
    grade 0 to 3, the chance of any grade above 0, and whether that is at least one half.

    A null or empty text has no features and gets the base rate. Without labels of both kinds
    all severities are 0. Repeated rows get equal results.
    """
    model = fit(docs, labels, label)

    def rows(c):
        known: dict[bytes, list[int]] = {}
        for k1, k2, doc, text in zip(c["k1"], c["k2"], c["doc_id"], c["text"]):
            if model is None:
                yield k1, k2, doc, 0.0, 0.0, False
                continue
            x = counted(words_of(text), known, model["vocabulary"])
            f = sum(model["weights"][i] * v for i, v in x.items())
            above = 1 / (1 + np.exp(-np.clip(f - model["cuts"], -40, 40)))
            yield k1, k2, doc, float(above.sum()), float(above[0]), bool(above[0] >= 0.5)

    names = ["k1", "k2", "doc_id", "severity", "p_toxic", "toxic"]
    types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.bool_()]
    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(plain, "k1 long, k2 long, doc_id long, severity double, p_toxic double, toxic boolean", rows, names, types)
