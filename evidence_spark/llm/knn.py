"""Exact top-k by inner product with a Voronoi join.

Queries are grouped by their nearest pivot; data vectors are not, but cut into slices by hash,
and each query is copied to every slice. For a query group with pivot p and
radius r, every query q and vector x have q.x within p.x -+ r|x|. The k-th largest lower bound,
merged from small summaries of each part of the data, bounds the group's k-th score from
below; a vector goes to a group only if its upper bound reaches that. Groups are solved
in blocks of bounded size, and the blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evidence_spark.session import scratch_table

SCALE = 256
#: Vectors and queries in a block on average; queries for which one more pivot is taken, and most pivots.
DATA_BLOCK, QUERY_BLOCK, QUERIES_A_PIVOT, MOST_PIVOTS = 8192, 512, 256, 256


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed doubles; shorter vectors are filled up with zeros, which add nothing."""
    out = np.zeros((len(column), width))
    for i, b in enumerate(column.to_pylist()):
        v = np.frombuffer(b)
        out[i, : len(v)] = v
    return out


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of every component as packed doubles, without vectors that are
    null or hold null, NaN or infinite components, or have no id. An empty vector has the score 0
    with any other. Repeated rows count once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))

    def pack(batches):
        for batch in batches:
            rows = [np.floor(np.array(x) * SCALE).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return good.distinct().mapInArrow(pack, "vec_id long, v binary")


def _groups(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each query with the number of its nearest pivot and its distance to it."""
    width = pivots.shape[1]

    def near(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0)
            g = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(g.astype(np.int32)), pa.array(np.sqrt(((x - pivots[g]) ** 2).sum(1)))], names=["vec_id", "v", "grp", "far"])

    return queries.mapInArrow(near, "vec_id long, v binary, grp int, far double")


def _bounds(data: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """Per group a value that each of its queries' k-th best score reaches. One of the data may
    be the query itself, so the (k + 1)-th largest lower bound counts."""
    groups = len(pivots)

    def part(batches):
        best = np.full((groups, k + 1), -np.inf)
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1])
            low = x @ pivots.T - np.sqrt((x * x).sum(1))[:, None] * radius
            best = -np.sort(-np.vstack([best.T, low]), axis=0)[: k + 1].T
        yield pa.RecordBatch.from_pydict({"grp": pa.array(range(groups), pa.int32()), "low": pa.array(best.tolist(), pa.list_(pa.float64()))})

    summaries = data.mapInArrow(part, "grp int, low array<double>")
    each = summaries.select("grp", F.explode("low").alias("low"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("low")))
    kth = {r["grp"]: r["low"] for r in each.withColumn("place", place).filter(F.col("place") == k + 1).collect()}
    return np.array([kth.get(g, -np.inf) for g in range(groups)])


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of all other vectors.

    Both are tables of ``scaled``; a query's own id never answers it. Ties go to the smaller
    vec_id. With fewer than ``k`` others all are returned, with none or no queries no rows. Scores are
    exact while inner products stay below 2**53. Pivots are queries with the smallest hashes; their
    number grows with the queries up to a fixed most, so what the driver holds is bounded.
    """
    data, queries = scratch_table(data, "knn-data"), scratch_table(queries, "knn-queries")
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("w")).first()
    n_queries = queries.count()
    shape = "query_id long, rank int, vec_id long, score long"
    if not size["n"] or not n_queries:
        return data.sparkSession.createDataFrame([], shape)
    width = max(size["w"], queries.agg(F.max(F.length("v"))).first()[0]) // 8
    wanted = min(MOST_PIVOTS, max(2, -(-n_queries // QUERIES_A_PIVOT)))
    chosen = queries.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("v"), "vec_id").limit(wanted).collect()
    pivots = _matrix(pa.array([bytes(r["v"]) for r in chosen], pa.binary()), width)
    grouped = scratch_table(_groups(queries, pivots), "knn-groups")
    summary = {r["grp"]: r for r in grouped.groupBy("grp").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([summary[g]["far"] if g in summary else 0.0 for g in range(len(pivots))])
    blocks = np.array([-(-summary[g]["n"] // QUERY_BLOCK) if g in summary else 0 for g in range(len(pivots))])
    bound = _bounds(data, pivots, radius, k)
    slices = max(1, -(-size["n"] // DATA_BLOCK))

    def replicate(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            reach = np.sqrt((x * x).sum(1))[:, None] * radius
            centre = x @ pivots.T
            need = centre + reach + 1e-9 * (np.abs(centre) + reach + 1) >= bound
            for g in range(len(pivots)):
                at = np.flatnonzero(need[:, g])
                for b in range(int(blocks[g])) if len(at) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(np.full(len(at), b, np.int32)), batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at))], names=["grp", "block", "vec_id", "v"])

    slice_of = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    sent = data.mapInArrow(replicate, "grp int, block int, vec_id long, v binary").withColumn("slice", slice_of)
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.element_at(F.array(*(F.lit(max(1, int(b))) for b in blocks)), F.col("grp") + 1)).cast("int")
    asked = grouped.select("grp", block_of.alias("block"), "vec_id", "v").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    key = ["grp", "block", "slice"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q_id, x_id = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(x_id, kind="stable")
            x_id, x = x_id[order], _matrix(right.column("v").combine_chunks(), width)[order]
            scores = _matrix(left.column("v").combine_chunks(), width) @ x.T
            for q, s in zip(q_id, scores):
                s = np.where(x_id == q, -np.inf, s)
                at = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                at = at[np.argsort(-s[at], kind="stable")][:k]
                at = at[x_id[at] != q]
                out[0] += [int(q)] * len(at)
                out[1] += x_id[at].tolist()
                out[2] += s[at].astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    best = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
