"""Document retrieval over the supplied texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark import policy
from evidence_spark.functions import text
from evidence_spark.operators import retrieval
from evidence_spark.plans import proxy
from evidence_spark.plans.oracle import with_ev
from evidence_spark.plans.queries_graph import _every, whole_graph
from evidence_spark.plans.registry import query
from evidence_spark.session import spread

SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def _indexable(table: str) -> str:
    marks = " + ".join(f"(length(d) - length(replace(d, '{t}', ''))) / {len(t)}" for t in policy.RAW_DUMP_TOKENS)
    return f"""cl AS (SELECT *, {_clean('text')} AS c FROM {table}),
    sm AS (SELECT *, c AS s, c AS d FROM cl),
    tk AS (SELECT *, list_filter(regexp_split_to_array(s, '{SPACE}'), lambda t: t <> '') AS toks, regexp_extract_all(s, '[A-Za-z][A-Za-z-]{{2,}}') AS words,
           len(regexp_extract_all(d, '(?i)\\b({'|'.join(policy.READABLE_WORDS)})\\b')) AS readable, {marks} AS marks FROM sm),
    idx AS (SELECT *, length(c) >= 80 AND NOT (d LIKE '%PDF-%' AND starts_with(d, '%PDF-') OR (marks >= 5 AND readable < 3)) AND NOT ({' OR '.join(f"contains(c, '{t}')" for t in policy.PLACEHOLDER_TEXTS)}) AND len(toks) > 0
      AND len(list_filter(toks, lambda t: regexp_full_match(t, '[A-Za-z0-9]'))) / len(toks) <= 0.35 AND len(words) >= 20
      AND len(list_distinct(list_transform(words, lambda w: lower(w)))) >= 12 AS text_available FROM tk)"""


def _keywords(x: str) -> str:
    tokens = f"list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda t: lower(t))"
    out = tokens
    for key, values in policy.QUESTION_SYNONYMS.items():
        words = [key, *values]
        hit = " OR ".join(f"contains(lower({x}), '{w}')" for w in words)
        out = f"list_concat({out}, CASE WHEN {hit} THEN [{', '.join(repr(w) for w in words)}] ELSE CAST([] AS VARCHAR[]) END)"
    return f"list_distinct({out})"


def _snippets(source: str) -> str:
    """Scored paragraphs of ``source`` (doc_id, text, keys, and any key columns)."""
    return f"""pt AS (SELECT *, regexp_split_to_array(regexp_replace(text, '\\.[ \\t\\n\\r\\f\\x0B]{{2,}}', '.' || chr(30), 'g'), '\\n[ \\t\\n\\r\\f\\x0B]*\\n|' || chr(30)) AS raw FROM {source}),
    pl AS (SELECT *, list_filter(list_transform(raw, lambda p: {_clean('p')}), lambda p: length(p) >= 80) AS longs FROM pt),
    pc AS (SELECT *, CASE WHEN len(longs) > 0 THEN longs ELSE [{_clean('text')}] END AS paras FROM pl WHERE trim(text) <> ''),
    pu AS (SELECT * EXCLUDE (raw, longs, paras), unnest(paras) AS p, generate_subscripts(paras, 1) - 1 AS position FROM pc),
    ps AS (SELECT *, len(list_filter(keys, lambda k: contains(lower(p), k))) + CASE WHEN contains(lower(p), 'information security') THEN 2 ELSE 0 END
           + CASE WHEN contains(lower(p), 'risk') THEN 1 ELSE 0 END AS score FROM pu)"""


def documents(spark, sf):
    """Whole documents. The text rules cost far more than reading, so a scan with fewer
    splits than cores is spread out first."""
    return spread(proxy.table(spark, sf, "documents").select("doc_id", "text"))


QUESTION = "What does the report say about the command and the network port for that avionics word"


@query("question_keywords", f"SELECT item_id, array_to_string(list_sort({_keywords('text')}), ' ') AS keywords FROM benchmark")
def question_keywords(spark, sf):
    return proxy.table(spark, sf, "benchmark").select("item_id", F.array_join(F.sort_array(text.question_keywords(F.col("text"))), " ").alias("keywords"))


@query("indexable_docs", "WITH " + _indexable("documents") + " SELECT doc_id, text_available FROM idx")
def indexable_docs(spark, sf):
    return retrieval.indexable(documents(spark, sf)).select("doc_id", "text_available")


@query("ranked_snippets", "WITH src AS (SELECT doc_id, text, " + _keywords(f"'{QUESTION}'") + " AS keys FROM documents), " + _snippets("src") + """
    SELECT doc_id, CAST(rn AS INTEGER) AS rank, score, position, p AS snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS rn FROM ps WHERE score > 0) WHERE rn <= 3""")
def ranked_snippets(spark, sf):
    """Best three paragraphs of every document for one question."""
    return retrieval.rank_snippets(documents(spark, sf), QUESTION)


def _document_context(words: str) -> str:
    """SQL of the document context, given that of ``wd``, the words by which a document is found."""
    return "WITH " + _indexable("documents") + """,
    good AS (SELECT doc_id, text FROM idx WHERE text_available), ask AS (SELECT item_id AS question_id, """ + _keywords("text") + """ AS keys FROM benchmark),
    wk AS (SELECT question_id, unnest(keys) AS w FROM ask), wd AS (""" + words + """),
    met AS (SELECT question_id, doc_id FROM (SELECT DISTINCT question_id, doc_id FROM wk JOIN wd USING (w)) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY doc_id DESC) <= 12),
    src AS (SELECT question_id, doc_id, text, keys FROM met JOIN ask USING (question_id) JOIN good USING (doc_id)), """ + _snippets("src") + """,
    top AS (SELECT question_id, doc_id, count(*) AS n, arg_min(p, rn) AS best FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, position) AS rn FROM ps WHERE score > 0) WHERE rn <= 3 GROUP BY ALL)
    SELECT question_id, doc_id, coalesce(t.n, 0) AS snippets, coalesce(t.best, s.text) AS shown, CASE WHEN t.n > 0 THEN 'relevant text found' ELSE 'no text matched' END AS note
    FROM src s LEFT JOIN top t USING (question_id, doc_id)"""


def _asked_documents(spark, sf):
    docs = documents(spark, sf).withColumn("uploaded_at", F.lit(1704067200) + F.col("doc_id"))
    return docs, proxy.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query("document_context", _document_context("SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')) AS w FROM good"))
def document_context(spark, sf):
    """Every question with the twelve newest documents that share a keyword with it."""
    return retrieval.document_context(*_asked_documents(spark, sf), 12)


@query("document_context_inside", _document_context("SELECT doc_id, w FROM good JOIN (SELECT DISTINCT w FROM wk) ON contains(lower(text), w)"))
def document_context_inside(spark, sf):
    """The same with keywords also found inside longer words."""
    return retrieval.document_context(*_asked_documents(spark, sf), 12, inside=True)


@query("unreadable_documents", "WITH " + _indexable("documents") + """ SELECT doc_id, CAST(1704067200 + doc_id AS BIGINT) AS uploaded_at,
    CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' ELSE 'text is not readable' END AS note FROM idx WHERE NOT coalesce(text_available, false)""")
def unreadable_documents(spark, sf):
    """Documents left out of every document context, with the reason."""
    return retrieval.unreadable_documents(_asked_documents(spark, sf)[0])


@query("question_context", with_ev("""SELECT r.question_id, e.sequence, e.evidence_id, e.severity
      FROM ev e JOIN (SELECT event_id AS question_id, unnest(list_distinct([event_id + 1, k + 10, user_id + 10])) AS s FROM ev) r ON e.sequence = r.s"""))
def question_context(spark, sf):
    """Questions that name three sequences each, joined to the evidence they ask for."""
    ev = proxy.evidence(spark, sf)
    asked = F.concat(F.lit("Compare sequence #"), F.col("event_id") + 1, F.lit(", seq "), F.col("k") + 10, F.lit(" and #"), F.col("user_id") + 10)
    questions = ev.select(F.col("event_id").alias("question_id"), asked.alias("question"))
    return retrieval.question_context(questions, ev).select("question_id", "sequence", "evidence_id", "severity")


def _some_open(ev):
    """Every 50th event asks for two sequences; each third of these questions names none, each
    third one that no record has."""
    n = F.col("event_id") + 1
    asked = F.when(n % 3 == 0, "Which evidence matters most").when(n % 3 == 1, F.concat(F.lit("Show sequence #"), n + 90_000_000)).otherwise(F.concat(F.lit("Compare seq "), n, F.lit(" and #"), n + 1))
    return ev.filter(n % 50 == 0).select(F.col("event_id").alias("question_id"), asked.alias("question"))


OPEN = """oq AS (SELECT event_id AS question_id, event_id + 1 AS n FROM ev WHERE (event_id + 1) % 50 = 0),
oa AS (SELECT question_id, unnest(CASE n % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [n + 90000000] ELSE [n, n + 1] END) AS sequence FROM oq),
ot AS (SELECT sequence, evidence_id, severity FROM ev ORDER BY 1 - predicted_anomaly, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 4 END, anomaly_score, sequence, evidence_id LIMIT 10),
oc AS (SELECT question_id, e.sequence, evidence_id, severity, true AS requested FROM ev e JOIN oa USING (sequence)
  UNION ALL SELECT question_id, ot.*, false FROM oq, ot WHERE question_id NOT IN (SELECT question_id FROM ev JOIN oa USING (sequence)))"""


@query("question_context_open", with_ev("SELECT question_id, sequence, evidence_id, severity, requested FROM oc", OPEN))
def question_context_open(spark, sf):
    """Questions of which some name no sequence, or none that is found: they get the top records."""
    ev = proxy.evidence(spark, sf)
    return retrieval.question_context(_some_open(ev), ev).select("question_id", "sequence", "evidence_id", "severity", "requested")


@query("question_edges", _every("SELECT DISTINCT question_id, source, target, relation, label FROM edges JOIN om ON id = source OR id = target", OPEN, """ow AS (SELECT question_id, sequence FROM oa UNION SELECT question_id, sequence FROM oc),
om0 AS (SELECT DISTINCT question_id, id FROM nodes JOIN ow ON TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) = sequence WHERE kind = 'event'),
om AS (SELECT * FROM om0 UNION ALL SELECT question_id, id FROM oq, (SELECT id FROM nodes WHERE kind = 'event' ORDER BY risk DESC, id LIMIT 10) WHERE question_id NOT IN (SELECT question_id FROM om0))"""))
def question_edges(spark, sf):
    """Edges of the whole graph around the records of each of these questions."""
    ev = proxy.evidence(spark, sf)
    questions, g = _some_open(ev), whole_graph(spark, sf)
    return retrieval.question_edges(questions, retrieval.question_context(questions, ev), g.nodes, g.edges).select("question_id", "source", "target", "relation", "label")
