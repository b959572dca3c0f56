"""Context of questions: requested or top records, and the edges around them."""

from evidence_spark.operators import retrieval

POOL = "sequence long, evidence_id string, severity string, anomaly_score double, predicted_anomaly int"


def test_every_question_gets_records_and_edges(spark):
    pool = spark.createDataFrame([(i, f"e{i}", "HIGH" if i == 14 else "LOW", 0.01 * i, int(i > 12)) for i in range(10, 20)], POOL)
    texts = ["Show sequence #11 and #13", "What matters most", "Show sequence #999", None]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
    context = retrieval.question_context(questions, pool, top=2)
    got = {}
    for r in context.collect():
        got.setdefault((r["question_id"], r["requested"]), set()).add(r["sequence"])
    assert got == {(0, True): {11, 13}, (1, False): {14, 13}, (2, False): {14, 13}, (3, False): {14, 13}}
    nodes = spark.createDataFrame([("event-13", "event", 5), ("event-1", "event", 9), ("event-113", "event", 1), ("source-13", "source", 0)], "id string, kind string, risk int")
    edges = spark.createDataFrame([("source-13", "event-13", "observed"), ("event-13", "event-13", "loop"), ("source-13", "event-113", "observed"), ("event-1", "t", "target")], "source string, target string, relation string")
    found = retrieval.question_edges(questions, context, nodes, edges, top=1)
    rows = {(r["question_id"], r["target"], r["relation"]) for r in found.collect()}
    assert rows == {(q, "event-13", x) for q in range(4) for x in ("observed", "loop")} and found.count() == 8
    alone = retrieval.question_edges(questions.filter("question_id = 1"), context.limit(0), nodes, edges, top=1)
    assert [(r["source"], r["target"]) for r in alone.collect()] == [("event-1", "t")]


def test_document_context_has_all_documents_by_default(spark):
    prose = "The network report lists alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega risk controls and further findings about ports, words, buses and frames."
    docs = spark.createDataFrame([(i, i, prose) for i in range(20)], "doc_id long, uploaded_at long, text string")
    questions = spark.createDataFrame([(1, "Which kappa findings")], "question_id long, question string")
    assert retrieval.document_context(docs, questions).count() == 20
    assert {r["doc_id"] for r in retrieval.document_context(docs, questions, 3).collect()} == {17, 18, 19}


def test_keywords_inside_words_equal_a_plain_search(spark):
    vocabulary = ["network", "networking", "report", "port", "ports", "airport", "part-is", "aaaa", "aaa", "bus"]
    keywords = ["port", "net", "aaa", "work", "part-is", "zebra", "bus", "rep"]
    tables = [spark.createDataFrame([(w,) for w in words], "word string") for words in (vocabulary, keywords)]
    found = retrieval.words_with(*tables).collect()
    assert {tuple(r) for r in found} == {(k, w) for k in keywords for w in vocabulary if k in w}
    assert len(found) == len({tuple(r) for r in found})
    assert retrieval.words_with(tables[0].limit(0), tables[1]).isEmpty() and retrieval.words_with(tables[0], tables[1].limit(0)).isEmpty()


def test_document_context_inside_longer_words(spark):
    prose = "The network reports list alpha beta gamma delta epsilon zeta theta kappas lambda sigma omega risk controls and further findings about words, buses and frames."
    docs = spark.createDataFrame([(1, 1, prose), (2, 2, prose.replace("kappas", "other")), (3, 3, None), (4, 4, "")], "doc_id long, uploaded_at long, text string")
    questions = spark.createDataFrame([(1, "kappa"), (2, "kap"), (3, None), (4, "")], "question_id long, question string")
    assert retrieval.document_context(docs, questions).isEmpty()
    got = retrieval.document_context(docs, questions, 1, inside=True).collect()
    assert {(r["question_id"], r["doc_id"], r["note"]) for r in got} == {(1, 1, "relevant text found"), (2, 1, "relevant text found")}
    notes = retrieval.unreadable_documents(docs.unionByName(spark.createDataFrame([(5, 5, "short")], docs.schema))).collect()
    assert {(r["doc_id"], r["note"]) for r in notes} == {(3, "no text"), (4, "no text"), (5, "text is not readable")}


def test_the_vocabulary_meets_keywords_without_stored_trigrams_or_word_lists(spark, monkeypatch):
    prose = "The network reports list alpha beta gamma delta epsilon zeta theta kappas kappa subkappa lambda sigma omega risk controls and further findings about words and frames."
    docs = spark.createDataFrame([(i, i % 4, prose) for i in range(9)] + [(8, 8 % 4, prose)], "doc_id long, uploaded_at long, text string")
    questions = spark.createDataFrame([(1, "kappa"), (2, "lambd")], "question_id long, question string")
    stored, plain = {}, retrieval.scratch_table
    monkeypatch.setattr(retrieval, "scratch_table", lambda df, label: stored.setdefault(label, plain(df, label)))
    got = retrieval.document_context(docs, questions, 3, inside=True).select("question_id", "doc_id").distinct().collect()
    # newest first, then the smaller number; three words of a document hold the first keyword
    assert {tuple(r) for r in got} == {(q, d) for q in (1, 2) for d in (3, 7, 2)}
    assert set(stored) == {"searchable", "asked", "vocabulary"}
