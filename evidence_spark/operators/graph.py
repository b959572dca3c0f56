"""Provenance graph: vertices and edges as tables, algorithms as bounded join rounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import scalars
from evidence_spark.operators import feeds, filters, joins
from evidence_spark.operators.ordered import event_rank, temporal_edges
from evidence_spark.session import scratch_table, shuffle_partitions

#: Cells and arcs that the sources followed at a time may have in a task: about 150 MB.
CELLS = 1 << 21

# "first" means the smallest event time, then the smallest text

def _ids() -> dict[str, Column]:
    return {
        "domain": scalars.slug("domain", F.col("domain")),
        "source": scalars.slug("source", F.col("source_component")),
        "target": scalars.slug("target", F.col("target_component")),
        "pattern": scalars.slug("pattern", F.col("pattern")),
        "event": F.col("event_id"),
    }


def _node_rows(events: DataFrame) -> DataFrame:
    labels = {
        "domain": scalars.title_case(F.col("domain")), "source": F.col("source_component"),
        "target": F.col("target_component"), "pattern": F.col("pattern"), "event": F.col("label"),
    }
    entries = [
        F.struct(
            node.alias("id"), F.lit(kind).alias("kind"), labels[kind].alias("label"),
            F.col("domain").alias("domain"), (F.col("risk") if kind == "event" else F.lit(0.0)).alias("risk"),
        )
        for kind, node in _ids().items()
    ]
    return events.select("event_us", "event_id", "sequence", F.explode(F.array(*entries)).alias("n"))


def graph_nodes(events: DataFrame) -> DataFrame:
    """One row per node: attributes of its first event, number of events, highest risk.

    A domain node covers a large share of all events, so its members are not collected
    here; ``node_sequences`` lists them as rows.
    """
    # whole-number state first, so the pass over all rows is a hash aggregation; the
    # text of the first event is then chosen among the few variants of a node
    variants = _node_rows(events).groupBy("n.id", "n.kind", "n.label", "n.domain").agg(
        F.count(F.lit(1)).alias("_n"), F.max("n.risk").alias("_risk"), F.min("event_us").alias("_at")
    )
    nodes = variants.groupBy("id").agg(
        F.min(F.struct("_at", "label", "domain", "kind")).alias("_f"), F.sum("_n").alias("event_count"), F.max("_risk").alias("risk")
    )
    kind = F.col("_f.kind")
    return nodes.select(
        "id", kind.alias("kind"), F.col("_f.label").alias("label"), scalars.short_label(F.col("_f.label")).alias("short_label"),
        F.col("_f.domain").alias("domain"), "event_count", "risk", scalars.lookup(kind, policy.NODE_LAYERS, 2).alias("layer"),
    )


def node_sequences(events: DataFrame) -> DataFrame:
    """The distinct sequences each node is related to."""
    return _node_rows(events).select(F.col("n.id").alias("id"), "sequence").filter(F.col("sequence").isNotNull()).distinct()


def graph_edges(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per (source, target, relation): first label and base weight plus repeats."""
    ids = _ids()
    rules = [
        ("domain", "source", F.lit("contains"), "domain"),
        ("domain", "pattern", F.lit("pattern cluster"), "domain_pattern"),
        ("source", "target", F.col("flow"), "flow"),
        ("source", "event", F.col("observed"), "observed"),
        ("event", "target", F.lit("affects"), "target"),
        ("event", "pattern", F.lit("matches"), "pattern"),
    ]
    entries = [
        F.struct(ids[a].alias("source"), ids[b].alias("target"), label.alias("label"), F.lit(relation).alias("relation"))
        for a, b, label, relation in rules
    ]
    rows = events.select("event_us", F.explode(F.array(*entries)).alias("e")).filter(F.col("e.source") != F.col("e.target"))
    variants = rows.groupBy("e.source", "e.target", "e.relation", "e.label").agg(F.count(F.lit(1)).alias("_c"), F.min("event_us").alias("_at"))
    edges = variants.groupBy("source", "target", "relation").agg(
        F.min(F.struct("_at", "label"))["label"].alias("label"), F.sum("_c").alias("_n")
    )
    if pairs is not None:
        edges = edges.unionByName(pairs.filter(F.col("source") != F.col("target")).withColumn("_n", F.lit(1).cast("bigint")))
    base = scalars.lookup(F.col("relation"), policy.EDGE_WEIGHTS, 1)
    return edges.select("source", "target", "relation", "label", (base + F.col("_n") - 1).cast("bigint").alias("weight"))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    filtered: DataFrame
    selected: DataFrame


def build_graph(normalized: DataFrame, max_events: int | None = 10, now: Column | None = None, **filter_options) -> Graph:
    """Filter, select, rank, then nodes, edges and related pairs of the selection."""
    filtered = filters.filter_events(normalized, now=now, **filter_options)
    ranked = feeds.select_top(filtered, max_events).withColumn("_falling", -F.col("risk"))
    selected = scratch_table(event_rank(ranked, ["event_us", "_falling", "event_id"]).drop("_falling"), "selected")
    pairs = joins.correlate_events(selected)
    return Graph(graph_nodes(selected), graph_edges(selected, pairs), filtered, selected)


# --- metrics -------------------------------------------------------------------------------------

def simple_edges(edges: DataFrame) -> DataFrame:
    """The directed graph without parallel relations and self loops."""
    return edges.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.max("weight").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    arcs = simple_edges(edges)
    ends = arcs.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        arcs.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.count()
    both = F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))
    centrality = scalars.round_half_up(both / F.lit(float(n - 1)), 4) if n > 1 else F.lit(0.0)
    return nodes.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
        F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"), centrality.alias("degree_centrality"),
    )


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.count()
    value = F.count(F.lit(1)) / F.lit(float(n * (n - 1))) if n > 1 else F.lit(0.0)
    return simple_edges(edges).agg(F.lit(n).cast("bigint").alias("nodes"), F.count(F.lit(1)).alias("arcs"), scalars.round_half_up(value, 4).alias("density"))


def most_central(nodes: DataFrame, scores: DataFrame, column: str = "centrality") -> DataFrame:
    best = nodes.join(scores, "id").agg(F.max_by(F.struct("id", "label", column), F.struct(F.col(column), F.col("id"))).alias("_b"))
    return best.select("_b.*")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components as (id, component), the smallest id naming it.

    Each round takes the smallest label among the neighbours and then follows labels
    once more, so long chains shrink quickly.
    """
    links = scratch_table(undirected(edges), "links")
    labels = scratch_table(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        offered = links.join(labels, links.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("_offer"))
        lower = labels.join(offered, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", F.coalesce("_offer", "component")).alias("_new")
        )
        hops = labels.select(F.col("id").alias("_new"), F.col("component").alias("_far"))
        moved = scratch_table(
            lower.join(hops, "_new").select("id", "_old", F.least("_new", "_far").alias("component")), "labels"
        )
        labels = moved.select("id", "component")
        if moved.filter(F.col("_old") != F.col("component")).isEmpty():
            return labels


def component_summary(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, events, highest risk and domains; the domain list is short by nature."""
    return nodes.join(labels, "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") == "event").alias("event_count"),
        F.max("risk").alias("max_risk"), F.array_join(F.sort_array(F.collect_set(F.coalesce("domain", F.lit("unknown")))), ",").alias("domains"),
    )


def _expanded(front: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tail, arc) of all arcs out of the cells ``front``; a cell is a row of a source, times the nodes, plus a node."""
    at = front % (len(first) - 1)
    count = first[at + 1] - first[at]
    tail = np.repeat(front, count)
    arc = np.arange(len(tail)) + np.repeat(first[at] - np.cumsum(count) + count, count)
    return tail, arc


def _dependencies(sources: np.ndarray, first: np.ndarray, heads: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per node the sum, over ``sources``, of its share in their shortest paths: distances until
    none falls, paths counted in the order of the shortest arcs, shares back along them."""
    n = len(first) - 1
    starts = np.arange(len(sources)) * n + sources
    dist = np.full(len(sources) * n, np.iinfo(np.int64).max)
    dist[starts], front = 0, starts
    while len(front):
        tail, arc = _expanded(front, first)
        head, d = tail - tail % n + heads[arc], dist[tail] + weights[arc]
        lower = d < dist[head]
        np.minimum.at(dist, head[lower], d[lower])
        front = np.unique(head[lower])
    tail, arc = _expanded(np.flatnonzero(dist < np.iinfo(np.int64).max), first)
    head = tail - tail % n + heads[arc]
    short = dist[tail] + weights[arc] == dist[head]
    tail, head = tail[short], head[short]
    waiting, paths, share = np.bincount(head, minlength=len(dist)), np.zeros(len(dist)), np.zeros(len(dist))
    paths[starts], front, layers = 1.0, starts, []
    while len(front):
        low, high = np.searchsorted(tail, front), np.searchsorted(tail, front, "right")
        arc = np.arange((high - low).sum()) + np.repeat(high - np.cumsum(high - low), high - low)
        layers.append(arc)
        np.add.at(paths, head[arc], paths[tail[arc]])
        np.subtract.at(waiting, head[arc], 1)
        met = np.unique(head[arc])
        front = met[waiting[met] == 0]
    for arc in reversed(layers):
        np.add.at(share, tail[arc], paths[tail[arc]] / paths[head[arc]] * (1.0 + share[head[arc]]))
    share[starts] = 0.0
    return share.reshape(len(sources), n).sum(axis=0)


def _shares(roots: pa.Table, arcs: pa.Table) -> pa.Table:
    """(k, x): ``_dependencies`` of one group of sources, so many at a time that their cells and arcs
    stay within ``CELLS``, or one."""
    a, b = (arcs[c].to_numpy() for c in ("a", "b"))
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(ends[: len(a)], kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ends[: len(a)], minlength=len(names)))])
    heads, weights = ends[len(a) :][order], arcs["w"].to_numpy()[order]
    sources = np.searchsorted(names, roots["k"].to_numpy())
    step, total = max(1, CELLS // (len(names) + len(a))), np.zeros(len(names))
    for at in range(0, len(sources), step):
        total += _dependencies(sources[at : at + step], first, heads, weights)
    some = total > 0
    return pa.table({"k": names[some], "x": total[some]})


def betweenness(nodes: DataFrame, edges: DataFrame, weight_as: str = "distance", pivots: DataFrame | None = None) -> DataFrame:
    """Normalised betweenness from all pivots: distances, path counts along shortest arcs, and
    dependencies back along them. Without pivots every node is one and the result is exact; with
    a table of pivot ids the sum is scaled up to all nodes.

    Sources do not need each other, so they are dealt into groups that meet the arcs by a cogroup.
    A group holds the arcs, as numbers, and the cells of a bounded number of sources at a time;
    its sums leave it once. The number of Spark jobs does not depend on the length of the paths.
    """
    arcs = simple_edges(edges).select("source", "target", (F.col("weight") if weight_as == "distance" else F.lit(1)).cast("bigint").alias("w"))
    arcs = scratch_table(arcs, "arcs")
    ends = arcs.select(F.col("source").alias("id")).unionByName(arcs.select(F.col("target").alias("id"))).distinct()
    # numbers are stored, as they depend on the partition of a row
    named = scratch_table(ends.withColumn("k", F.monotonically_increasing_id()), "ends")
    n = nodes.count()
    roots = (pivots if pivots is not None else nodes).select("id")
    used = roots.count()
    spark = nodes.sparkSession
    groups = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    dealt = roots.distinct().join(named, "id").select(F.pmod(F.xxhash64("k"), F.lit(groups)).alias("g"), "k")
    numbered = arcs.join(named.select(F.col("id").alias("source"), F.col("k").alias("a")), "source").join(named.select(F.col("id").alias("target"), F.col("k").alias("b")), "target")
    copies = scratch_table(numbered.select("a", "b", "w"), "numbered").withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    parts = dealt.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(_shares, "k long, x double")
    scale = float(n) / used / ((n - 1) * (n - 2)) if n > 2 and used else 0.0
    scored = parts.groupBy("k").agg((F.sum("x") * F.lit(scale)).alias("_c")).join(named, "k").select("id", "_c")
    return nodes.select("id").join(scored, "id", "left").select("id", scalars.round_half_up(F.coalesce("_c", F.lit(0.0)), 4).alias("centrality"))


# --- paths ---------------------------------------------------------------------------------------

def shortest_paths(arcs: DataFrame, roots: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest path from every root to every target, within ``max_hops`` if given; the smallest
    node list wins among equals. Each round extends the newest paths by one arc and
    keeps one path per (root, node)."""
    front = scratch_table(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array("id").alias("path")), "front")
    seen = front
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = front.join(arcs, front.node == arcs.a).select("root", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = scratch_table(fresh.groupBy("root", "node").agg(F.min("path").alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(targets.select(F.col("id").alias("node")), "node", "left_semi").filter(F.col("root") != F.col("node"))


def attack_paths(nodes: DataFrame, edges: DataFrame, top: int | None = None, max_nodes: int | None = None, n: int | None = None) -> DataFrame:
    """Paths between events, best first by risk and then by length. ``top`` takes the
    riskiest events as ends only, ``max_nodes`` bounds a path, ``n`` the list."""
    arcs = scratch_table(undirected(edges), "arcs")
    known = scratch_table(nodes.select("id", "short_label", "risk", "kind"), "nodes")
    ends = scratch_table(known.filter(F.col("kind") == "event").orderBy(F.desc("risk"), "id").transform(filters.page, top), "ends")
    found = shortest_paths(arcs, ends, ends, max_nodes and max_nodes - 1)
    order = lambda side: ends.select(F.col("id").alias(side), F.struct(-F.col("risk"), F.col("id")).alias(f"_{side}"))
    pairs = found.join(order("root"), "root").join(order("node"), "node").filter(F.col("_root") < F.col("_node"))
    steps = pairs.select("root", "node", F.posexplode("path").alias("pos", "id"), "path")
    steps = steps.withColumn("next", F.get("path", F.col("pos") + 1)).drop("path")
    label = edges.select(
        F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"), "label", "relation"
    ).groupBy("_a", "_b").agg(F.min_by("label", F.struct("relation", "label")).alias("link"))
    steps = steps.join(known.select("id", "short_label", F.col("risk").alias("_risk")), "id")
    steps = steps.withColumn("_a", F.least("id", "next")).withColumn("_b", F.greatest("id", "next")).join(
        label, ["_a", "_b"], "left"
    )
    # a list has one entry per step of one path
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    paths = steps.groupBy("root", "node").agg(
        F.array_join(in_order("id"), " > ").alias("path"), F.array_join(F.slice(in_order("short_label"), 1, 5), " -> ").alias("summary"),
        F.array_join(F.filter(in_order("link"), lambda x: x.isNotNull()), ", ").alias("relations"),
        (F.count(F.lit(1)) - 1).alias("length"), F.max("_risk").alias("risk"),
    )
    return paths.withColumnsRenamed({"root": "source", "node": "target"}).orderBy(F.desc("risk"), "length", "source", "target").transform(filters.page, n)


def timeline_graph(events: DataFrame, limit: int | None = 8) -> tuple[DataFrame, DataFrame]:
    """Source, event and target of each event by time, with ``then`` edges between
    neighbouring events."""
    chosen = events.orderBy("event_us", "event_id").limit(limit) if limit else events
    ranked = scratch_table(event_rank(chosen, ["event_us", "event_id"]), "timeline")
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c))
    event = F.concat(F.lit("event-"), F.col("sequence").cast("string"))
    shown = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.col("severity"))
    entries = F.array(
        F.struct(name("source", "source_component").alias("id"), F.lit("source").alias("kind"), F.col("source_component").alias("label"), F.lit(0.0).alias("risk")),
        F.struct(name("target", "target_component").alias("id"), F.lit("target").alias("kind"), F.col("target_component").alias("label"), F.lit(0.0).alias("risk")),
        F.struct(event.alias("id"), F.lit("anomaly").alias("kind"), shown.alias("label"), F.col("risk").alias("risk")),
    )
    nodes = ranked.select("rank", F.explode(entries).alias("n")).groupBy("n.id").agg(F.min_by("n", "rank").alias("_n")).select("_n.*")
    links = F.array(
        F.struct(name("source", "source_component").alias("source"), event.alias("target"), F.col("observed").alias("label"), F.lit(False).alias("temporal")),
        F.struct(event.alias("source"), name("target", "target_component").alias("target"), F.lit("affected").alias("label"), F.lit(False).alias("temporal")),
    )
    flows = ranked.select(F.explode(links).alias("e")).select("e.*")
    return nodes, flows.unionByName(temporal_edges(ranked.withColumn("_event", event), "_event", "event_us", "event_id"))


def temporal_paths(nodes: DataFrame, edges: DataFrame, n: int | None = None, max_hops: int | None = None) -> DataFrame:
    """Directed paths between anomalies, best first by risk, temporal steps and length."""
    arcs = scratch_table(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "arcs")
    ends = nodes.filter(F.col("kind") == "anomaly")
    found = scratch_table(shortest_paths(arcs, ends, ends, max_hops), "temporal")
    steps = found.select("root", "node", F.posexplode("path").alias("pos", "id"), "path").withColumn("next", F.get("path", F.col("pos") + 1))
    then = edges.filter("temporal").select(F.col("source").alias("id"), F.col("target").alias("next"), F.lit(True).alias("_then")).distinct()
    steps = steps.join(then, ["id", "next"], "left").join(nodes.select("id", "risk"), "id")
    paths = steps.groupBy("root", "node").agg(
        F.array_join(F.min("path"), " > ").alias("path"), (F.count(F.lit(1)) - 1).alias("length"),
        F.bool_or(F.coalesce("_then", F.lit(False))).alias("temporal"), F.max("risk").alias("risk"),
    )
    return paths.withColumnsRenamed({"root": "source", "node": "target"}).orderBy(F.desc("risk"), F.desc("temporal"), "length", "source", "target").transform(filters.page, n)
