"""Provenance graph over the evidence: whole-table graph and top-event investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import events, feeds, filters, graph, joins, timeline
from evidence_spark.plans import oracle as o
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.queries_rows import NORMALIZED, normalized
from evidence_spark.plans.registry import query
from evidence_spark.session import scratch_table

# --- SQL: nodes, edges, related pairs -------------------------------------------------------------


def _graph_sql(source: str, prefix: str = "") -> str:
    """CTEs <prefix>nodes and <prefix>edges0 (without related pairs) over an event table."""
    ids = f"{o.slug('domain', 'domain')} AS d, {o.slug('source', 'source_component')} AS s, {o.slug('target', 'target_component')} AS t, {o.slug('pattern', 'pattern')} AS p"
    return f"""
{prefix}ids AS (SELECT *, {ids}, row_number() OVER (ORDER BY event_us, event_id, label) AS ord FROM {source}),
{prefix}nr AS (
  SELECT d AS id, 'domain' AS kind, {o.title('domain')} AS nlabel, domain, {o.dbl(0)} AS risk, ord, event_us FROM {prefix}ids
  UNION ALL SELECT s, 'source', source_component, domain, 0, ord, event_us FROM {prefix}ids
  UNION ALL SELECT t, 'target', target_component, domain, 0, ord, event_us FROM {prefix}ids
  UNION ALL SELECT p, 'pattern', pattern, domain, 0, ord, event_us FROM {prefix}ids
  UNION ALL SELECT event_id, 'event', label, domain, risk, ord, event_us FROM {prefix}ids),
{prefix}nodes AS (SELECT id, arg_min(kind, (event_us, nlabel, domain, kind)) AS kind, arg_min(nlabel, (event_us, nlabel, domain, kind)) AS label, arg_min(domain, (event_us, nlabel, domain, kind)) AS domain, count(*) AS event_count, max(risk) AS risk FROM {prefix}nr GROUP BY id),
{prefix}er AS (
  SELECT d AS source, s AS target, 'domain' AS relation, 'contains' AS elabel, event_us FROM {prefix}ids
  UNION ALL SELECT d, p, 'domain_pattern', 'pattern cluster', event_us FROM {prefix}ids
  UNION ALL SELECT s, t, 'flow', flow, event_us FROM {prefix}ids
  UNION ALL SELECT s, event_id, 'observed', observed, event_us FROM {prefix}ids
  UNION ALL SELECT event_id, t, 'target', 'affects', event_us FROM {prefix}ids
  UNION ALL SELECT event_id, p, 'pattern', 'matches', event_us FROM {prefix}ids),
{prefix}edges0 AS (SELECT source, target, relation, arg_min(elabel, (event_us, elabel)) AS label, count(*) - 1 + CASE relation WHEN 'domain_pattern' THEN 3 WHEN 'flow' THEN 3 ELSE 2 END AS weight
  FROM {prefix}er WHERE source <> target GROUP BY source, target, relation)"""


def _pairs_sql(source: str) -> str:
    """CTE pairs: every event with the last one before it by each rule, strongest rule first."""
    rules = [("source_component, target_component", 0), ("target_component", 2), ("pattern", 3), ("source_component", 4)]
    equal = " UNION ALL ".join(f"SELECT lag(event_id) OVER (PARTITION BY {key} ORDER BY rank, event_id) AS source, event_id AS target, {p} AS p FROM {source}" for key, p in rules)
    return f"""
roles AS (SELECT source_component AS place, rank, 0 AS tgt, event_id FROM {source} UNION ALL SELECT target_component, rank, 1, event_id FROM {source}),
pr AS ({equal}
  UNION ALL SELECT pe, event_id, 1 FROM (SELECT event_id, tgt, lag(event_id) OVER w AS pe, lag(tgt) OVER w AS pt FROM roles WINDOW w AS (PARTITION BY place ORDER BY rank, tgt, event_id)) WHERE tgt = 0 AND pt = 1
  UNION ALL SELECT pe, event_id, 5 FROM (SELECT event_id, event_us, lag(event_id) OVER w AS pe, lag(event_us) OVER w AS pu FROM {source} WINDOW w AS (PARTITION BY domain ORDER BY rank, event_id)) WHERE event_us - pu <= 1800000000),
pairs AS (SELECT source, target, ['shared_flow', 'pivot', 'shared_target', 'shared_pattern', 'shared_source', 'domain_sequence'][p + 1] AS relation,
  ['same flow', 'pivot', 'same target', 'same pattern', 'same source', 'same domain'][p + 1] AS label, [5, 5, 4, 4, 4, 2][p + 1] AS weight
  FROM (SELECT source, target, min(p) AS p FROM pr WHERE source IS NOT NULL AND source <> target GROUP BY source, target))"""


WHOLE = _graph_sql("norm")

# the whole graph with related events: every event once, ranked by time
EVERY = f"""allev AS (SELECT *, row_number() OVER (ORDER BY event_us, -risk, event_id) AS rank FROM (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_us, event_type, label, source_component, target_component) = 1)),
{_pairs_sql('allev')},
{_graph_sql('allev')},
edges AS (SELECT * FROM edges0 UNION ALL SELECT source, target, relation, label, weight FROM pairs)"""

SELECTED = f"""
@source,
filt AS (SELECT * FROM inv WHERE risk >= 0.5),
topn AS (SELECT event_id FROM filt ORDER BY risk DESC, abs(coalesce(anomaly_score, 0)) DESC, event_us DESC, event_id LIMIT 30),
sel AS (SELECT *, row_number() OVER (ORDER BY event_us, -risk, event_id) AS rank FROM (
  SELECT * FROM filt WHERE event_id IN (SELECT event_id FROM topn) OR event_type = 'mutation_attempt')),
{_pairs_sql('sel')},
{_graph_sql('sel')},
edges AS (SELECT * FROM edges0 UNION ALL SELECT source, target, relation, label, weight FROM pairs)"""

# what an investigation selects: ranked anomalies, newest security events, attempts those do not report
INVESTIGATION = NORMALIZED + """,
inv_keys AS (SELECT 'anomaly' AS t, sequence AS s, CAST(NULL AS BIGINT) AS u FROM (SELECT * FROM ev WHERE predicted_anomaly = 1 ORDER BY anomaly_score, evidence_id DESC LIMIT 80)),
newest AS (SELECT * FROM sec ORDER BY sequence DESC LIMIT 20),
fresh AS (SELECT * FROM att WHERE attempt_id NOT IN (SELECT attempt_id FROM newest WHERE attempt_id IS NOT NULL)),
inv0 AS (SELECT * FROM norm WHERE event_type = 'anomaly' AND sequence IN (SELECT s FROM inv_keys)
  UNION ALL SELECT n.* FROM norm n JOIN newest w ON n.event_us = w.occurred_us WHERE n.event_type <> 'anomaly' AND n.description = w.event
  UNION ALL SELECT n.* FROM norm n JOIN fresh f ON n.event_us = f.occurred_us AND n.description LIKE 'DB % Attempt Blocked'),
inv AS (SELECT * FROM inv0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_us) = 1)"""


def investigation(spark, sf):
    """Graph events of an investigation; one per event id, the earliest."""
    both = feeds.provenance_events(proxy.evidence(spark, sf), proxy.security_events(spark, sf), proxy.attempts(spark, sf), 80, 20)
    rows = events.normalize_events(both)
    first = rows.groupBy("event_id").agg(F.min_by(F.struct(*rows.columns), F.col("event_us")).alias("r"))
    return scratch_table(first.select("r.*"), "investigation")


def investigation_graph(spark, sf):
    return graph.build_graph(investigation(spark, sf), max_events=30)


def whole_graph(spark, sf):
    """The graph of all events, each event id once, with the links between related events."""
    rows = normalized(spark, sf)
    order = F.struct("event_us", "event_type", "label", "source_component", "target_component")
    first = rows.groupBy("event_id").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return graph.build_graph(first, max_events=None, severity_threshold=float("-inf"))


def _every(body: str, *extra: str, recursive: bool = False) -> str:
    return with_ev(body, NORMALIZED, EVERY, *extra, recursive=recursive)


def _sel(body: str, *extra: str, recursive: bool = False) -> str:
    return with_ev(body, SELECTED.replace("@source", INVESTIGATION.strip()), *extra, recursive=recursive)


@query("graph_nodes_all", with_ev("""SELECT id, kind, label, CASE WHEN length(label) <= 24 THEN label ELSE substring(label, 1, 23) || '.' END AS short_label, domain, event_count, risk,
    CASE kind WHEN 'domain' THEN 0 WHEN 'source' THEN 1 WHEN 'event' THEN 2 WHEN 'target' THEN 3 ELSE 4 END AS layer FROM nodes""", NORMALIZED, WHOLE))
def graph_nodes_all(spark, sf):
    return graph.graph_nodes(normalized(spark, sf))


@query("graph_edges_all", with_ev("SELECT source, target, relation, label, weight FROM edges0", NORMALIZED, WHOLE))
def graph_edges_all(spark, sf):
    return graph.graph_edges(normalized(spark, sf))


@query("node_sequences", with_ev("""SELECT DISTINCT n.id, i.sequence FROM nr n JOIN ids i USING (ord)""", NORMALIZED, WHOLE))
def node_sequences(spark, sf):
    return graph.node_sequences(normalized(spark, sf))


DEGREES = """
arcs AS (SELECT DISTINCT source, target FROM {edges}),
deg AS (SELECT n.id, (SELECT count(*) FROM {nodes}) AS n, coalesce(i.c, 0) AS in_degree, coalesce(u.c, 0) AS out_degree FROM {nodes} n
  LEFT JOIN (SELECT target AS id, count(*) AS c FROM arcs GROUP BY 1) i USING (id) LEFT JOIN (SELECT source AS id, count(*) AS c FROM arcs GROUP BY 1) u USING (id))"""
DEGREE_OUT = f"SELECT id, in_degree, out_degree, {o.half_up('CAST(in_degree + out_degree AS DOUBLE) / CAST(n - 1 AS DOUBLE)', 4)} AS degree_centrality FROM deg"


@query("degrees_all", with_ev(DEGREE_OUT, NORMALIZED, WHOLE, DEGREES.format(edges="edges0", nodes="nodes")))
def degrees_all(spark, sf):
    n = normalized(spark, sf)
    return graph.degrees(graph.graph_nodes(n), graph.graph_edges(n))


@query("components_all", with_ev("""SELECT m.id, c.component FROM (SELECT id, min(root) AS root FROM member GROUP BY id) m
    JOIN (SELECT root, min(id) AS component FROM member GROUP BY root) c USING (root)""", NORMALIZED, WHOLE, """
nd AS (SELECT DISTINCT n.id, i.d FROM nr n JOIN ids i USING (ord)),
dd AS (SELECT DISTINCT a.d AS a, b.d AS b FROM nd a JOIN nd b ON a.id = b.id),
closure AS (SELECT a AS d, a AS r FROM dd UNION SELECT dd.b, c.r FROM closure c JOIN dd ON dd.a = c.d),
member AS (SELECT nd.id, (SELECT min(r) FROM closure c WHERE c.d = nd.d) AS root FROM nd)""", recursive=True))
def components_all(spark, sf):
    n = normalized(spark, sf)
    return graph.components(graph.graph_nodes(n), graph.graph_edges(n))


@query("correlated_pairs", _sel("SELECT source, target, relation, label FROM pairs"))
def correlated_pairs(spark, sf):
    return joins.correlate_events(investigation_graph(spark, sf).selected)


@query("graph_nodes", _sel("SELECT id, kind, label, domain, event_count, risk FROM nodes"))
def graph_nodes(spark, sf):
    return investigation_graph(spark, sf).nodes.select("id", "kind", "label", "domain", "event_count", "risk")


@query("graph_edges", _sel("SELECT source, target, relation, label, weight FROM edges"))
def graph_edges(spark, sf):
    return investigation_graph(spark, sf).edges


@query("degrees", _sel(DEGREE_OUT, DEGREES.format(edges="edges", nodes="nodes")))
def degrees(spark, sf):
    g = investigation_graph(spark, sf)
    return graph.degrees(g.nodes, g.edges)


@query("density", _sel(f"""SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS arcs, {o.half_up('CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) * (count(*) - 1) FROM nodes) AS DOUBLE)', 4)} AS density
    FROM (SELECT DISTINCT source, target FROM edges)"""))
def density(spark, sf):
    g = investigation_graph(spark, sf)
    return graph.density(g.nodes, g.edges)


@query("components", _sel("""SELECT component, count(*) AS node_count, count(*) FILTER (kind = 'event') AS event_count, max(risk) AS max_risk,
    string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM nodes n JOIN (SELECT id, min(root) AS component FROM walk GROUP BY id) c USING (id) GROUP BY component""",
    """links AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
walk AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id)""", recursive=True))
def components(spark, sf):
    g = investigation_graph(spark, sf)
    return graph.component_summary(g.nodes, graph.components(g.nodes, g.edges))


@query("attack_paths", _sel("""SELECT source, target, path, length, risk FROM (
      SELECT f.root AS source, f.node AS target, array_to_string(f.path, ' > ') AS path, len(f.path) - 1 AS length,
        (SELECT max(n.risk) FROM nodes n WHERE n.id IN (SELECT unnest(f.path))) AS risk
      FROM (SELECT root, node, min(path) AS path FROM bfs b WHERE NOT EXISTS (SELECT 1 FROM bfs c WHERE c.root = b.root AND c.node = b.node AND c.hops < b.hops) GROUP BY root, node) f
      JOIN ends a ON a.id = f.root JOIN ends z ON z.id = f.node WHERE (a.risk > z.risk OR (a.risk = z.risk AND a.id < z.id))) ORDER BY risk DESC, length, source, target LIMIT 8""",
    """ends AS (SELECT id, risk FROM nodes WHERE kind = 'event' ORDER BY risk DESC, id LIMIT 12),
links AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
bfs AS (SELECT id AS root, id AS node, [id] AS path, 0 AS hops FROM ends
  UNION ALL SELECT * FROM (SELECT w.root, l.b AS node, min(list_append(w.path, l.b)) AS path, any_value(w.hops) + 1 AS hops FROM bfs w JOIN links l ON l.a = w.node
    WHERE w.hops < 7 AND NOT list_contains(w.path, l.b) GROUP BY w.root, l.b))""", recursive=True))
def attack_paths(spark, sf):
    g = investigation_graph(spark, sf)
    return graph.attack_paths(g.nodes, g.edges, 12, 8, 8).select("source", "target", "path", "length", "risk")


@query("attack_path_relations")
def attack_path_relations(spark, sf):
    """The same paths with labels, relations and a summary line."""
    g = investigation_graph(spark, sf)
    return graph.attack_paths(g.nodes, g.edges, 12, 8, 8)


@query("betweenness")
def betweenness(spark, sf):
    """Exact betweenness of the investigation graph (checked against brute force in tests)."""
    g = investigation_graph(spark, sf)
    return graph.betweenness(g.nodes, g.edges)


@query("top_nodes", _sel("SELECT id, kind, risk FROM nodes ORDER BY risk DESC, id LIMIT 6"))
def top_nodes(spark, sf):
    return feeds.top_nodes(investigation_graph(spark, sf).nodes).select("id", "kind", "risk")


@query("neighbours", _sel("""SELECT e.direction, e.other, e.relation, e.label, n.label AS other_label, n.kind AS other_kind FROM (
    SELECT 'Outgoing' AS direction, target AS other, relation, label FROM edges WHERE source = 'domain-integrity'
    UNION ALL SELECT 'Incoming', source, relation, label FROM edges WHERE target = 'domain-integrity') e LEFT JOIN nodes n ON n.id = e.other"""))
def neighbours(spark, sf):
    g = investigation_graph(spark, sf)
    return joins.neighbours(g.nodes, g.edges, "domain-integrity")


@query("induced_subgraph", _sel("""SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes ORDER BY risk DESC, id LIMIT 40) AND target IN (SELECT id FROM nodes ORDER BY risk DESC, id LIMIT 40)"""))
def induced_subgraph(spark, sf):
    g = investigation_graph(spark, sf)
    return joins.induced_subgraph(g.nodes, g.edges, 40, [F.desc("risk"), "id"])[1].select("source", "target", "relation")


@query("related_subgraph", _sel("""SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes WHERE contains(id || ' ' || label, 'Blocked')) OR target IN (SELECT id FROM nodes WHERE contains(id || ' ' || label, 'Blocked'))"""))
def related_subgraph(spark, sf):
    g = investigation_graph(spark, sf)
    return joins.related_subgraph(g.nodes, g.edges, ["Blocked"])[1].select("source", "target", "relation")


def _flagged(spark, sf):
    return events.normalize_events(filters.flagged(proxy.evidence(spark, sf)))


def _timeline(spark, sf, limit):
    return graph.timeline_graph(_flagged(spark, sf), limit)


def _ranked(spark, sf):
    return timeline.ranked_events(_flagged(spark, sf), ["event_us", "event_id"])


TL = """tl AS (SELECT *, row_number() OVER (ORDER BY event_us, event_id) AS rank FROM norm WHERE event_type = 'anomaly' AND sequence IN (SELECT sequence FROM ev WHERE predicted_anomaly = 1)
   ORDER BY event_us, event_id {limit}),
te AS (SELECT 'source-' || source_component AS source, 'event-' || sequence AS target, observed AS label, false AS temporal FROM tl
  UNION ALL SELECT 'event-' || sequence, 'target-' || target_component, 'affected', false FROM tl
  UNION ALL SELECT 'event-' || lag(sequence) OVER (ORDER BY rank), 'event-' || sequence, 'then', true FROM tl QUALIFY lag(sequence) OVER (ORDER BY rank) IS NOT NULL)"""


@query("timeline_graph", with_ev("SELECT source, target, label, temporal FROM te", NORMALIZED, TL.format(limit="LIMIT 8")))
def timeline_graph(spark, sf):
    """Graph of the first eight flagged events."""
    return _timeline(spark, sf, 8)[1]


@query("timeline_graph_all", with_ev("SELECT source, target, label, temporal FROM te", NORMALIZED, TL.format(limit="")))
def timeline_graph_all(spark, sf):
    """Graph of all flagged events."""
    return _timeline(spark, sf, None)[1]


@query("temporal_paths", with_ev("""SELECT source, target, path, length, temporal, risk FROM (
    SELECT 'event-' || a.sequence AS source, 'event-' || b.sequence AS target, string_agg('event-' || m.sequence, ' > ' ORDER BY m.rank) AS path, b.rank - a.rank AS length, true AS temporal, max(m.risk) AS risk
    FROM tl a JOIN tl b ON a.rank < b.rank JOIN tl m ON m.rank BETWEEN a.rank AND b.rank GROUP BY a.sequence, b.sequence, a.rank, b.rank) ORDER BY risk DESC, temporal DESC, length, source, target LIMIT 10""", NORMALIZED, TL.format(limit="LIMIT 8")))
def temporal_paths(spark, sf):
    """The ten best of all paths between the first eight flagged events."""
    return graph.temporal_paths(*_timeline(spark, sf, 8), 10)


@query("temporal_paths_all", with_ev("""SELECT p.source, p.target, string_agg('event-' || m.sequence, ' > ' ORDER BY m.rank) AS path, p.length, true AS temporal, p.risk FROM (
    SELECT 'event-' || a.sequence AS source, 'event-' || b.sequence AS target, a.rank AS first, b.rank AS last, b.rank - a.rank AS length, max(b.risk) OVER (PARTITION BY a.rank ORDER BY b.rank) AS risk
    FROM tl a JOIN tl b ON a.rank <= b.rank QUALIFY a.rank < b.rank ORDER BY risk DESC, length, source, target LIMIT 10) p
    JOIN tl m ON m.rank BETWEEN p.first AND p.last GROUP BY ALL""", NORMALIZED, TL.format(limit="")))
def temporal_paths_all(spark, sf):
    """The ten best of all paths between all flagged events."""
    return timeline.best_paths(_ranked(spark, sf), 10)


@query("temporal_paths_from_roots", with_ev("""SELECT 'event-' || a.sequence AS source, 'event-' || b.sequence AS target, b.rank - a.rank AS length, max(b.risk) OVER (PARTITION BY a.rank ORDER BY b.rank) AS risk
    FROM (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY domain ORDER BY risk DESC, rank) = 1) a JOIN tl b ON a.rank <= b.rank QUALIFY a.rank < b.rank""", NORMALIZED, TL.format(limit="")))
def temporal_paths_from_roots(spark, sf):
    """Paths from the riskiest flagged event of each domain to every later flagged event."""
    ranked = _ranked(spark, sf)
    rows = _flagged(spark, sf).select("domain", F.concat(F.lit("event-"), F.col("sequence").cast("string")).alias("id"))
    best = ranked.join(rows, "id").groupBy("domain").agg(F.min(F.struct(-F.col("risk"), "rank", "id")).alias("_m"))
    return timeline.paths_from(best.select("_m.rank", "_m.id"), timeline.risk_index(ranked))


# --- the whole graph ------------------------------------------------------------------------------

@query("correlated_pairs_all", _every("SELECT source, target, relation, label FROM pairs"))
def correlated_pairs_all(spark, sf):
    return joins.correlate_events(whole_graph(spark, sf).selected)


@query("density_all", _every(f"""SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS arcs, {o.half_up('CAST(count(*) AS DOUBLE) / (CAST((SELECT count(*) FROM nodes) AS DOUBLE) * ((SELECT count(*) FROM nodes) - 1))', 4)} AS density
    FROM (SELECT DISTINCT source, target FROM edges)"""))
def density_all(spark, sf):
    g = whole_graph(spark, sf)
    return graph.density(g.nodes, g.edges)


@query("top_nodes_all", _every("SELECT id, kind, risk FROM nodes ORDER BY risk DESC, id LIMIT 6"))
def top_nodes_all(spark, sf):
    return feeds.top_nodes(whole_graph(spark, sf).nodes).select("id", "kind", "risk")


@query("neighbours_all", _every("""SELECT e.direction, e.other, e.relation, e.label, n.label AS other_label, n.kind AS other_kind FROM (
    SELECT 'Outgoing' AS direction, target AS other, relation, label FROM edges WHERE source = 'domain-integrity'
    UNION ALL SELECT 'Incoming', source, relation, label FROM edges WHERE target = 'domain-integrity') e LEFT JOIN nodes n ON n.id = e.other"""))
def neighbours_all(spark, sf):
    g = whole_graph(spark, sf)
    return joins.neighbours(g.nodes, g.edges, "domain-integrity")


@query("induced_subgraph_all", _every("""SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes ORDER BY risk DESC, id LIMIT 40) AND target IN (SELECT id FROM nodes ORDER BY risk DESC, id LIMIT 40)"""))
def induced_subgraph_all(spark, sf):
    g = whole_graph(spark, sf)
    return joins.induced_subgraph(g.nodes, g.edges, 40, [F.desc("risk"), "id"])[1].select("source", "target", "relation")


@query("related_subgraph_all", _every("""SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes WHERE contains(id || ' ' || label, 'Blocked')) OR target IN (SELECT id FROM nodes WHERE contains(id || ' ' || label, 'Blocked'))"""))
def related_subgraph_all(spark, sf):
    g = whole_graph(spark, sf)
    return joins.related_subgraph(g.nodes, g.edges, ["Blocked"])[1].select("source", "target", "relation")
