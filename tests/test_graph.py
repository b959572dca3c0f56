import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import graph, joins


def tables(spark, edges, extra=()):
    ids = sorted({v for e in edges for v in e[:2]} | set(extra))
    nodes = spark.createDataFrame([(i, "event", i, i, "d", 1, 0.5 + 0.01 * k, 2) for k, i in enumerate(ids)],
                                  "id string, kind string, label string, short_label string, domain string, event_count int, risk double, layer int")
    rows = spark.createDataFrame([(a, b, "r", "l", w) for a, b, w in edges], "source string, target string, relation string, label string, weight long")
    return nodes, rows


def brandes(nodes, edges, weighted):
    """Plain betweenness by listing shortest paths."""
    import heapq

    out, score = {}, dict.fromkeys(nodes, 0.0)
    for a, b, w in edges:
        if a != b:
            out.setdefault(a, {})[b] = max(out.get(a, {}).get(b, 0), w if weighted else 1)
    for s in nodes:
        dist, sigma, pred, order, heap = {s: 0}, {s: 1.0}, {s: []}, [], [(0, s)]
        done = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in out.get(v, {}).items():
                if u not in dist or d + w < dist[u]:
                    dist[u], sigma[u], pred[u] = d + w, sigma[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif d + w == dist[u]:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in pred[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("weight_as", ["distance", "none"])
def test_betweenness_equals_plain_algorithm(spark, weight_as):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    edges = [(a, b, rng.randrange(1, 4)) for a in names for b in names if a != b and rng.random() < 0.2] + [("n1", "n1", 2)]
    nodes, rows = tables(spark, edges, names)
    got = {r.id: r.centrality for r in graph.betweenness(nodes, rows, weight_as).collect()}
    want = brandes(names, edges, weight_as == "distance")
    assert all(abs(got[v] - want[v]) < 1e-4 for v in names)


def test_components_degrees_density(spark):
    edges = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), ("y", "x", 1), ("x", "x", 1)]
    nodes, rows = tables(spark, edges, ["lone"])
    got = {r.id: r.component for r in graph.components(nodes, rows).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "lone": "lone"}
    deg = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(nodes, rows).collect()}
    assert deg["a"] == (1, 1) and deg["x"] == (1, 1) and deg["lone"] == (0, 0)
    assert graph.density(nodes, rows).first()["arcs"] == 5


def test_long_chain_component(spark):
    names = [f"c{i:03d}" for i in range(120)]
    nodes, rows = tables(spark, [(a, b, 1) for a, b in zip(names, names[1:])])
    assert {r.component for r in graph.components(nodes, rows).collect()} == {"c000"}


def test_attack_paths_smallest_path_and_length_limit(spark):
    chain = [f"p{i}" for i in range(9)]
    edges = [(a, b, 1) for a, b in zip(chain, chain[1:])] + [("s", "m1", 1), ("m1", "t", 1), ("s", "m2", 1), ("m2", "t", 1)]
    nodes, rows = tables(spark, edges)
    nodes = nodes.withColumn("kind", F.when(F.col("id").isin("p0", "p8", "s", "t"), "event").otherwise("pattern"))
    got = graph.attack_paths(nodes, rows, 12, 8, 8).collect()
    assert [r.path for r in got] == ["t > m1 > s"]  # p0 to p8 has nine nodes
    assert sorted(r.length for r in graph.attack_paths(nodes, rows).collect()) == [2, 8]


def test_pair_precedence(spark):
    rows = [(1, "e1", "a", "b", "p", "d", 0), (2, "e2", "a", "b", "p", "d", 10), (3, "e3", "b", "c", "q", "d", 20), (4, "e4", "z", "c", "q", "x", 30), (5, "e5", "y", "v", "r", "d", 1_799_000_000), (6, "e6", "w", "u", "s", "d", 3_600_000_000)]
    events = spark.createDataFrame(rows, "rank int, event_id string, source_component string, target_component string, pattern string, domain string, event_us long")
    got = {(r.source, r.target): r.relation for r in joins.correlate_events(events).collect()}
    # each event with the last one before it by every rule, the strongest rule of a pair
    assert got == {("e1", "e2"): "shared_flow", ("e2", "e3"): "pivot", ("e3", "e4"): "shared_target", ("e3", "e5"): "domain_sequence"}


def test_related_events_grow_with_the_events(spark):
    rows = [(i, f"e{i:05d}", "a", "b", "none", "d", i) for i in range(7000)]
    events = spark.createDataFrame(rows, "rank int, event_id string, source_component string, target_component string, pattern string, domain string, event_us long")
    assert joins.correlate_events(events).count() == 6999


def test_betweenness_of_a_long_path(spark):
    names = [f"n{i}" for i in range(6)]
    nodes, rows = tables(spark, [(a, b, 1) for a, b in zip(names, names[1:])])
    got = {r.id: r.centrality for r in graph.betweenness(nodes, rows).collect()}
    assert [got[n] for n in names] == [0.0, 0.2, 0.3, 0.3, 0.2, 0.0]


def test_betweenness_stores_as_few_tables_for_long_paths(spark, monkeypatch):
    stored, plain = [], graph.scratch_table
    monkeypatch.setattr(graph, "scratch_table", lambda df, label: stored.append(label) or plain(df, label))
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b, 1) for a, b in zip(names, names[1:])] + [(a, b, rng.randrange(1, 4)) for a in names for b in names if a < b and rng.random() < 0.05]
    edges += [("n05", "n02", 3), ("n30", "n28", 1)]
    nodes, rows = tables(spark, edges, ["lone"])
    got = {r.id: r.centrality for r in graph.betweenness(nodes, rows).collect()}
    want = brandes([*names, "lone"], edges, True)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-4 for v in want)
    assert len(stored) < 10


def test_shares_of_a_group_do_not_depend_on_how_many_sources_go_at_a_time(monkeypatch):
    rng = random.Random(9)
    arcs = sorted({(a, b) for a in range(30) for b in range(30) if a != b and rng.random() < 0.1})
    arcs = pa.table({"a": [1 << 40 | a for a, _ in arcs], "b": [1 << 40 | b for _, b in arcs], "w": [1 + (a + b) % 3 for a, b in arcs]})
    roots = pa.table({"k": arcs["a"].unique()})
    whole = graph._shares(roots, arcs)
    monkeypatch.setattr(graph, "CELLS", 1)
    single = graph._shares(roots, arcs)
    assert whole["k"].equals(single["k"]) and whole["x"].to_pylist() == pytest.approx(single["x"].to_pylist())
