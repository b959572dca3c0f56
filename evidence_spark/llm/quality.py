"""Quality classifier: random Fourier features of document statistics, ridge, isotonic scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.session import scratch_table

#: Statistics of a text, in the order of the vector ``x``.
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "line_bytes", "upper", "digit", "space", "non_ascii", "stop", "bang", "pipe", "symbol",
    "distinct_words", "distinct_pairs", "repeated_lines", "entropy", "words_end_mark", "last_end_mark", "short_words", "long_words",
]
_SYMBOLS = list(b"#*$%&<>@^_~{}[]\\=+")
FEATURES, FOLDS, BINS = 256, 3, 400


def statistics(body: bytes) -> list[float]:
    """The statistics of one text; an empty one has zeros."""
    n = len(body)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    words, lines = body.split(), [x for x in body.split(b"\n") if x.strip()]
    w = max(1, len(words))
    share = count[count > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.fromiter((x[-1] for x in words), np.uint8, len(words))
    return [
        np.log1p(n), np.log1p(len(words)), min(40.0, lengths.sum() / w), np.log1p(n / max(1, len(lines))),
        count[65:91].sum() / n, count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, count[128:].sum() / n,
        (count[46] + count[44]) / w, count[33] / w, count[124] / w, sum(count[c] for c in _SYMBOLS) / w,
        len(set(words)) / w, len(set(zip(words, words[1:]))) / w, 1 - len(set(lines)) / max(1, len(lines)),
        -(share * np.log2(share)).sum(), float(np.isin(ends, (33, 36, 37, 38, 42, 35, 124)).sum()) / w, float(body.rstrip()[-1:] in (b".", b"!", b"?")),
        (lengths <= 3).sum() / w, (lengths >= 12).sum() / w,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, x): one vector of statistics for each row of ``docs``."""

    def rows(c):
        for k1, k2, doc, body in zip(c["k1"], c["k2"], c["doc_id"], c["body"]):
            yield k1, k2, doc, [float(v) for v in statistics(body)]

    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body")
    return map_rows(plain, "k1 long, k2 long, doc_id long, x array<double>", rows, ["k1", "k2", "doc_id", "x"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())])


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from; a row without an id counts as one to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _directions(width: int, bandwidth: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(seed)
    return draw.normal(0, 1 / bandwidth, (width, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """cos(xW + b) of the standardised statistics, scaled, with a constant in front."""
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    out = np.sqrt(2 / FEATURES) * np.cos(z @ model["w"] + model["b"])
    return np.hstack([np.ones((len(x), 1)), out])


def _sums(train: DataFrame, model: dict) -> dict[int, np.ndarray]:
    """Per fold the sums of F'F, F'y over all rows: each partition adds up its own, one row
    of the matrix each, and Spark adds those; what returns has a fixed size."""
    size = FEATURES + 1

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, len(STATISTICS))
            y, fold = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                z = fourier(x[fold == f], model)
                more = np.hstack([z.T @ z, (z.T @ y[fold == f])[:, None]])
                total[f] = total[f] + more if f in total else more
        for f, m in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([int(f)] * size, pa.int32()), "i": pa.array(range(size), pa.int32()), "v": pa.array([r.tobytes() for r in m], pa.binary())})

    def add(key, table):
        rows = np.sum([np.frombuffer(v) for v in table.column("v").to_pylist()], axis=0)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "v": pa.array([rows.tobytes()], pa.binary())})

    shape = "fold int, i int, v binary"
    summed = train.select("x", "y", "fold").mapInArrow(part, shape).groupBy("fold", "i").applyInArrow(add, shape)
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["fold"], np.zeros((size, size + 1)))[r["i"]] = np.frombuffer(bytes(r["v"]))
    return out


def _ridge(m: np.ndarray, penalty: float) -> np.ndarray:
    size = m.shape[0]
    keep = np.eye(size) * penalty
    keep[0, 0] = 1e-9
    return np.linalg.solve(m[:, :size] + keep, m[:, size])


def isotonic(position: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: block centres and their shares."""
    blocks: list[list[float]] = []
    for p, o, c in zip(position, ones, count):
        blocks.append([p * c, o, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", bandwidth: float = 6.0, penalty: float = 0.3, seed: int = 11) -> dict | None:
    """A model from the labelled rows that are not held out; None where there are none.

    Mean and spread of the statistics, the normal equations and the calibration bins are sums
    over all labelled rows. The isotonic curve sees only scores of rows that their ridge
    solution did not learn from (``FOLDS``). A document labelled twice counts twice; a null
    label is no label.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    train = stats.join(known, "doc_id").filter(~held_out(F.col("doc_id")))
    train = scratch_table(train.select("x", "y", (F.xxhash64("doc_id") % FOLDS + FOLDS).cast("int").alias("fold")).withColumn("fold", F.col("fold") % FOLDS), "quality-train")
    columns = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])).alias(name) for i, name in enumerate(STATISTICS)]
    moments = train.agg(F.count(F.lit(1)).alias("n"), *columns).first()
    if not moments["n"]:
        return None
    mean, spread = (np.array([moments[name][j] for name in STATISTICS]) for j in (0, 1))
    w, b = _directions(len(STATISTICS), bandwidth, seed)
    model = {"mean": mean, "scale": np.where(spread > 1e-9, spread, 1.0), "w": w, "b": b}
    sums = _sums(train, model)
    everything = sum(sums.values())
    model["ridge"] = _ridge(everything, penalty)
    without = {f: _ridge(everything - m, penalty) if len(sums) > 1 else model["ridge"] for f, m in sums.items()}

    def bins(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, len(STATISTICS))
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            z = fourier(x, model)
            raw = np.array([z[i] @ without[f] for i, f in enumerate(fold)])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), "y": batch.column(1)})

    counted = train.select("x", "y", "fold").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    position = (np.array([r["bin"] for r in counted]) + 0.5) / BINS * 2 - 0.5
    model["at"], model["share"] = isotonic(position, np.array([r["ones"] for r in counted]), np.array([r["n"] for r in counted], float))
    return model


def _score(x: np.ndarray, model: dict) -> np.ndarray:
    raw = fourier(x, model) @ model["ridge"]
    # a thousandth of the raw score orders what the isotonic steps leave equal
    return np.clip(0.999 * np.interp(raw, model["at"], model["share"]) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(k1, k2, doc_id, held_out, score, predicted), one row for each row of ``docs``.

    The score is the calibrated probability of label 1, from the text alone. Null and empty
    texts have statistics of zero and are scored like any other. Without labelled rows every
    score is 0.5. Repeated rows get equal scores; other columns of ``docs`` play no part.
    """
    stats = scratch_table(document_statistics(docs), "quality-stats")
    model = fit(stats, labels, label)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(3).to_pylist()).reshape(-1, len(STATISTICS))
            s = _score(x, model) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["k1", "k2", "doc_id", "score", "predicted"])

    scored = stats.mapInArrow(score, "k1 long, k2 long, doc_id long, score double, predicted int")
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged."""
    verdicts = classify(docs, labels).filter("predicted = 0").select("k1", "k2").distinct()
    rejected = scratch_table(verdicts, "quality-rejected")
    return join_checked(keyed(docs).select("row", "k1", "k2"), rejected, ["k1", "k2"], "left_anti").select("row.*")
