"""Isolation forests per group: training, scoring, attribution and explanations.

Spark samples, groups and distributes; NumPy builds one small tree or moves one batch of
rows through the trees. Sampling and randomness derive from row ids and the seed, so a
model does not depend on how the data happens to be partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StructField, StructType

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators import joins
from evidence_spark.operators.ordered import exact_percentile
from evidence_spark.schemas import TREE_NODE
from evidence_spark.session import scratch_table, shuffle_partitions, sized, spread

EULER_GAMMA = 0.5772156649015329
MAX_MODEL_ROWS = 4_000_000  # tree nodes per broadcast; more groups are scored in turns


# --- features -----------------------------------------------------------------------------

def packet_features(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Size, rate, their clipped z-scores and the three policy flags as doubles."""
    scored = joins.apply_zscores(df, stats, "domain", ["packet_size", "frequency"])
    return scored.withColumns({name: F.col(name).cast("double") for name in policy.PACKET_FEATURES})


def word_features(df: DataFrame, stats: DataFrame, key: str = "src") -> DataFrame:
    """Status bits, parity, z-score of the data field and word rate as doubles."""
    parsed = df.withColumns(
        {
            "ssm_int": scalars.bits_to_int(F.col("ssm_bits")),
            "data_bits_int": scalars.bits_to_int(F.col("data_bits")),
            "parity_valid": scalars.parity_valid(F.col("raw_hex")),
        }
    )
    scored = joins.apply_zscores(parsed, stats, key, ["data_bits_int"], False)
    renamed = scored.withColumnRenamed("data_bits_int_zscore", "data_bits_zscore")
    return renamed.withColumns({name: F.col(name).cast("double") for name in policy.WORD_FEATURES})


# --- training -------------------------------------------------------------------------------

@dataclass
class Forest:
    features: list[str]
    trees: DataFrame
    thresholds: DataFrame | None
    scores: DataFrame | None = None  # raw scores of the rows trained on, by group and row id


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_rows(df: DataFrame, group: str, row_id: str, n_trees: int, sample_size: int, seed: int) -> DataFrame:
    """Up to ``sample_size`` rows per (group, tree), without replacement.

    Two hash thresholds leave a bounded pool: the first thins a large group to a pool
    that all trees share, the second picks the candidates of each tree. Then the
    smallest hashes of each tree are taken.
    """
    sizes = sized(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    pool_target = float(8 * n_trees * sample_size)
    pooled = df.join(sizes, group).withColumn("_q", F.least(F.lit(1.0), F.lit(pool_target) / F.col("_n")))
    pooled = pooled.filter(_uniform(F.col(row_id), F.lit(seed)) < F.col("_q"))
    chance = F.least(F.lit(1.0), F.lit(2.0 * sample_size) / (F.col("_n") * F.col("_q")))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: _uniform(F.col(row_id), t, F.lit(seed + 1)) < chance)
    exploded = pooled.withColumn("tree", F.explode(trees)).withColumn("_h", F.xxhash64(F.col(row_id), F.col("tree"), F.lit(seed + 2)))
    # about twice the sample per (group, tree), whatever the size of the group
    order = Window.partitionBy(group, "tree").orderBy("_h", row_id)
    return exploded.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample_size).drop("_n", "_q", "_r")


def mean_path(n: np.ndarray) -> np.ndarray:
    """Average depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m, out)


def _grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one random tree: (node, feature, threshold, left, right, depth, rows)."""
    nodes, todo, count = [], [(0, 0, np.arange(len(x)))], 1
    draws = rng.random((2 * len(x) + 1, 2))
    while todo:
        node, depth, rows = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        feature = int(usable[int(draws[node, 0] * len(usable))])
        cut = float(low[feature] + draws[node, 1] * (high[feature] - low[feature]))
        goes_left = part[:, feature] <= cut
        if goes_left.all() or not goes_left.any():
            cut = float(low[feature])
            goes_left = part[:, feature] <= cut
        left, right = count, count + 1
        count += 2
        nodes.append((node, feature, cut, left, right, depth, len(rows)))
        todo.append((right, depth + 1, rows[~goes_left]))
        todo.append((left, depth + 1, rows[goes_left]))
    return nodes


def grow_trees(sampled: DataFrame, group: str, features: list[str], seed: int, sample_size: int, jitter: float) -> DataFrame:
    """One tree per (group, tree) from at most ``sample_size`` rows."""
    limit = int(np.ceil(np.log2(max(sample_size, 2))))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model_group, tree = str(key[0]), int(key[1])
        rows = rows.sort_values("_h")
        rng = np.random.default_rng([seed, tree, *model_group.encode()])
        x = rows[features].to_numpy(dtype=float)
        x = x + rng.normal(0.0, jitter, x.shape)
        grown = _grow_tree(x, limit, rng)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "depth", "n_rows"])
        out.insert(0, "tree", tree)
        out.insert(0, "model_group", model_group)
        out["sample_rows"] = len(x)
        return out[TREE_NODE.names]

    slim = sampled.select(F.col(group).cast("string").alias("model_group"), "tree", "_h", *features)
    # the rows are few but each tree costs CPU: keep the tasks apart instead of coalescing
    slim = slim.repartition(shuffle_partitions(sampled.sparkSession), "model_group", "tree")
    return slim.groupBy("model_group", "tree").applyInPandas(build, TREE_NODE)


def fit_forest(
    df: DataFrame, group: str, row_id: str, features: list[str], label: str = "is_anomaly",
    n_trees: int = 200, sample_size: int = 256, seed: int = 42, jitter: float = 0.01,
) -> Forest:
    """A forest per group with a threshold at the labelled share of anomalies."""
    needed = scratch_table(df.select(group, row_id, label, *features), "features")
    trees = scratch_table(grow_trees(sample_rows(needed, group, row_id, n_trees, sample_size, seed), group, features, seed, sample_size, jitter), "trees")
    share = needed.groupBy(F.col(group).cast("string").alias("model_group")).agg(
        F.least(F.greatest(F.avg(label), F.lit(0.001)), F.lit(0.5)).alias("fraction")
    )
    scores = scratch_table(raw_scores(needed.select(group, row_id, *features), Forest(features, trees, None), group), "scores")
    by_group = scores.select(F.col(group).cast("string").alias("model_group"), "raw_score")
    thresholds = scratch_table(exact_percentile(by_group, ["model_group"], "raw_score", share, "threshold"), "thresholds")
    return Forest(features, trees, thresholds, scores.select(group, row_id, "raw_score"))


# --- scoring ----------------------------------------------------------------------------------

def _pack(trees: pd.DataFrame) -> dict[str, dict]:
    """Flat node arrays per group, all trees padded to one width. A leaf leads back to
    itself, so every row can take the same number of steps in every tree."""
    packed = {}
    for model_group, rows in trees.groupby("model_group"):
        ids = np.sort(rows["tree"].unique())
        width = int(rows["node"].max()) + 1
        base = np.searchsorted(ids, rows["tree"].to_numpy()) * width
        at = base + rows["node"].to_numpy()
        size = len(ids) * width
        inner = rows["feature"].to_numpy() >= 0
        pack = {
            "feature": np.zeros(size, dtype=np.int32), "threshold": np.full(size, np.inf),
            "children": np.repeat(np.arange(size, dtype=np.int32), 2), "is_leaf": np.ones(size, dtype=bool),
            "n_rows": np.zeros(size), "value": np.zeros(size),
            "roots": (np.arange(len(ids)) * width).astype(np.int32), "levels": int(rows["depth"].max()),
            "norm": float(mean_path(np.array([rows["sample_rows"].max()]))[0]) or 1.0,
        }
        pack["n_rows"][at] = rows["n_rows"]
        pack["value"][at] = rows["depth"].to_numpy() + mean_path(rows["n_rows"].to_numpy())
        nodes = at[inner]
        pack["is_leaf"][nodes] = False
        pack["feature"][nodes] = rows["feature"].to_numpy()[inner]
        pack["threshold"][nodes] = rows["threshold"].to_numpy()[inner]
        pack["children"][2 * nodes] = base[inner] + rows["left"].to_numpy()[inner]
        pack["children"][2 * nodes + 1] = base[inner] + rows["right"].to_numpy()[inner]
        packed[str(model_group)] = pack
    return packed


def _path_lengths(pack: dict, x: np.ndarray) -> np.ndarray:
    """Mean path length of every row over all trees of its group."""
    flat = np.ascontiguousarray(x).ravel()
    start = (np.arange(len(x), dtype=np.int64) * x.shape[1])[:, None]
    node = np.broadcast_to(pack["roots"], (len(x), len(pack["roots"])))
    for _ in range(pack["levels"]):
        right = flat.take(start + pack["feature"].take(node)) > pack["threshold"].take(node)
        node = pack["children"].take(2 * node + right)
    return pack["value"].take(node).mean(axis=1)


def _by_part(df: DataFrame, trees: DataFrame, group: str) -> Iterator[tuple[pd.DataFrame, DataFrame]]:
    """The tree table in pieces that are small enough to send to every executor, one at a
    time, each with the rows of its groups. Rows of groups without a tree come with the first
    piece, so they are kept whatever the number of pieces."""
    sizes = trees.groupBy("model_group").count().orderBy("model_group").collect()
    turns, current, rows = [], [], 0
    for size in sizes:
        if current and rows + size["count"] > MAX_MODEL_ROWS:
            turns.append(current)
            current, rows = [], 0
        current.append(size["model_group"])
        rows += size["count"]
    if current:
        turns.append(current)
    name = F.col(group).cast("string")
    for i, names in enumerate(turns or [[]]):
        others = [n for j, turn in enumerate(turns) if j != i for n in turn]
        mine = ~F.coalesce(name.isin(others), F.lit(False)) if i == 0 else name.isin(names)
        yield trees.filter(F.col("model_group").isin(names)).toPandas(), df.filter(mine) if len(turns) > 1 else df


def raw_scores(df: DataFrame, forest: Forest, group: str) -> DataFrame:
    """Add ``raw_score``, between -1 (most isolated) and 0."""
    features, spark = forest.features, df.sparkSession
    schema = StructType([*df.schema.fields, StructField("raw_score", DoubleType())])
    out = None
    for part, mine in _by_part(df, forest.trees, group):
        model = spark.sparkContext.broadcast(_pack(part))

        def score(batches, model=model):
            for rows in batches:
                result = np.full(len(rows), np.nan)
                names = rows[group].astype(str).to_numpy()
                x = rows[features].to_numpy(dtype=float)
                for name in np.unique(names):
                    pack = model.value.get(name)
                    if pack is not None:
                        mine = np.flatnonzero(names == name)
                        for chunk in np.array_split(mine, len(mine) // 1000 + 1):
                            result[chunk] = -np.power(2.0, -_path_lengths(pack, x[chunk]) / pack["norm"])
                yield rows.assign(raw_score=result)

        scored = spread(mine).mapInPandas(score, schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def score_forest(df: DataFrame, forest: Forest, group: str, model_used: Column) -> DataFrame:
    """Add decision value, flag, severity and model tag. Groups without a model drop out."""
    return _decided(raw_scores(df, forest, group).filter(~F.isnan("raw_score")), forest, group, model_used)


def score_trained(df: DataFrame, forest: Forest, group: str, row_id: str, model_used: Column) -> DataFrame:
    """As ``score_forest`` for the rows the forest was trained on: their raw scores are known
    from setting its threshold, so no row passes the trees twice."""
    known = forest.scores.filter(~F.isnan("raw_score"))
    return _decided(df.join(known, [group, row_id]), forest, group, model_used)


def _decided(scored: DataFrame, forest: Forest, group: str, model_used: Column) -> DataFrame:
    limits = forest.thresholds.select(F.col("model_group").alias("_g"), "threshold")
    decided = scored.join(limits, F.col(group).cast("string") == F.col("_g")).drop("_g")
    return decided.withColumn("anomaly_score", F.col("raw_score") - F.col("threshold")).withColumns(
        {
            "predicted_anomaly": (F.col("anomaly_score") < 0).cast("bigint"),
            "severity": scalars.severity_band(F.col("anomaly_score")),
            "model_used": model_used,
        }
    ).drop("raw_score", "threshold")


# --- attribution --------------------------------------------------------------------------------

def _leaf_bounds(pack: dict, root: int, n_features: int) -> tuple:
    """Box, share of training rows per feature and value of every leaf of a tree."""
    lows, highs, shares, values = [], [], [], []
    todo = [(root, np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features))]
    while todo:
        node, low, high, share = todo.pop()
        if pack["is_leaf"][node]:
            lows.append(low), highs.append(high), shares.append(share), values.append(pack["value"][node])
            continue
        feature, cut = pack["feature"][node], pack["threshold"][node]
        for side in (0, 1):
            child = pack["children"][2 * node + side]
            box = [low.copy(), high.copy(), share.copy()]
            if side == 0:
                box[1][feature] = min(high[feature], cut)
            else:
                box[0][feature] = max(low[feature], cut)
            box[2][feature] *= pack["n_rows"][child] / pack["n_rows"][node]
            todo.append((child, *box))
    return np.array(lows), np.array(highs), np.array(shares), np.array(values)


def _leaf_table(low: np.ndarray, high: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley contribution of every leaf for every set of features whose tests are passed.

    A leaf counts with a product over features: 0 or 1 for a present feature, its share
    for an absent one. Coalitions are summed by size through polynomial coefficients.
    """
    n_leaves, d = low.shape
    passes = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    used = np.isfinite(low) | np.isfinite(high)
    present = np.where(used[:, None, :], passes[None], 1.0)
    absent = np.broadcast_to(share[:, None, :], present.shape)
    table = np.zeros((n_leaves, 1 << d, d))
    choose = np.ones(d)
    for k in range(1, d):
        choose[k] = choose[k - 1] * (d - k) / k
    for j in range(d):
        if not used[:, j].any():
            continue
        sums = np.zeros((d, n_leaves, 1 << d))  # by number of present features
        sums[0] = 1.0
        for i in range(d):
            if i != j:
                sums[1:] = sums[1:] * absent[:, :, i] + sums[:-1] * present[:, :, i]
                sums[0] *= absent[:, :, i]
        weighted = np.tensordot(1.0 / (d * choose), sums, axes=1)
        table[:, :, j] = weighted * (present[:, :, j] - absent[:, :, j]) * value[:, None]
    return table


def _attributions(pack: dict, x: np.ndarray, chunk: int = 500) -> np.ndarray:
    """Tree by tree, so that only one table is held at a time."""
    n, d = x.shape
    total = np.zeros((n, d))
    for root in pack["roots"]:
        low, high, share, value = _leaf_bounds(pack, int(root), d)
        table = _leaf_table(low, high, share, value)
        leaf = np.arange(len(value))[None, :]
        for at in range(0, n, chunk):
            part = x[at:at + chunk]
            mask = np.zeros((len(part), len(value)), dtype=np.int32)
            for j in range(d):
                column = part[:, j][:, None]
                mask |= ((column > low[:, j]) & (column <= high[:, j])).astype(np.int32) << j
            total[at:at + chunk] += table[leaf, mask].sum(axis=1)
    return total / len(pack["roots"])


def attribute(flagged: DataFrame, forest: Forest, group: str, names: dict[str, str] = policy.FEATURE_DISPLAY_NAMES) -> DataFrame:
    """Exact path-dependent Shapley values of the mean path length, as a map, and the two
    features of largest size. A negative value shortens the path, so it raises suspicion.
    """
    features, spark = forest.features, flagged.sparkSession
    width = len(features)
    schema = StructType([*flagged.schema.fields, *(StructField(f"_phi{i}", DoubleType()) for i in range(width))])
    out = None
    for part, mine in _by_part(flagged, forest.trees, group):
        model = spark.sparkContext.broadcast(_pack(part))

        def explain_batches(batches, model=model):
            for rows in batches:
                phi = np.zeros((len(rows), width))
                group_names = rows[group].astype(str).to_numpy()
                x = rows[features].to_numpy(dtype=float)
                for name in np.unique(group_names):
                    pack = model.value.get(name)
                    if pack is None:
                        continue
                    mine = np.flatnonzero(group_names == name)
                    phi[mine] = _attributions(pack, x[mine])
                yield rows.assign(**{f"_phi{i}": phi[:, i] for i in range(width)})

        explained = spread(mine).mapInPandas(explain_batches, schema)
        out = explained if out is None else out.unionByName(explained)
    shown = [names.get(f, f) for f in features]
    entries = F.array(*(F.struct((-F.abs(F.col(f"_phi{i}"))).alias("size"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(shown)))
    top = F.transform(F.slice(F.sort_array(entries), 1, 2), lambda e: e["name"])
    values = F.map_from_arrays(F.array(*(F.lit(n) for n in shown)), F.array(*(F.col(f"_phi{i}") for i in range(width))))
    return out.withColumns({"shap_values": values, "top_features": top}).drop(*(f"_phi{i}" for i in range(width)))


# --- explanations -----------------------------------------------------------------------------------

def _drives(*features: str) -> Column:
    """One of the features is among the top two and pulls the score down."""
    hit = F.lit(False)
    for name in features:
        hit = hit | (F.array_contains("top_features", name) & (F.coalesce(F.col("shap_values")[name], F.lit(0.0)) < 0))
    return hit


def explain_packets(df: DataFrame, stats: DataFrame) -> DataFrame:
    """One or two sentences per flagged packet row."""
    means = stats.select("domain", F.round("packet_size_mean").cast("bigint").alias("_size"), F.round("frequency_mean").cast("bigint").alias("_rate"))
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    said = F.concat_ws(
        " ",
        F.when(_drives("packet_size", "packet_size_zscore"), F.concat(F.lit("Packet of "), whole("packet_size"), F.lit(" bytes, where "), F.coalesce(whole("_size"), F.lit("0")), F.lit(" is usual for the domain."))),
        F.when(_drives("frequency", "frequency_zscore"), F.concat(F.lit("Rate of "), whole("frequency"), F.lit(" per second, where "), F.coalesce(whole("_rate"), F.lit("0")), F.lit(" is usual for the domain."))),
        F.when(_drives("cross_domain_flag"), F.lit("Sender and receiver are in different network zones.")),
        F.when(_drives("port_anomaly_flag"), F.concat(F.lit("Port "), F.col("port").cast("string"), F.lit(" is not expected in the "), "domain", F.lit(" domain."))),
        F.when(_drives("protocol_anomaly_flag"), F.concat(F.lit("Protocol "), "protocol", F.lit(" is not expected in the "), "domain", F.lit(" domain."))),
    )
    return df.join(sized(means, "means"), "domain", "left").withColumn(
        "explanation_text", F.coalesce(scalars.filled(said), F.lit("Packet traffic deviates from its baseline."))
    ).drop("_size", "_rate")


def explain_words(df: DataFrame, label: str = "src") -> DataFrame:
    said = F.concat_ws(
        " ",
        F.when(_drives("ssm_bits"), F.lit("Status bits of the word are not valid.")),
        F.when(_drives("parity_bit"), F.lit("The parity of the word is wrong.")),
        F.when(_drives("data_bits"), F.concat(F.lit("Data field of label "), F.col(label), F.lit(" is out of its usual range."))),
        F.when(_drives("frequency"), F.concat(F.lit("Word rate of "), F.col("frequency").cast("bigint").cast("string"), F.lit(" per second is unusual."))),
    )
    return df.withColumn("explanation_text", F.coalesce(scalars.filled(said), F.lit("Bus words deviate from their baseline.")))
