"""The random field against enumeration of all label sequences, slopes and held-out languages."""

import itertools
import zlib

import numpy as np

from evidence_spark.llm import language
from llm_cases import DOCS, awkward


def plain(emit, move, start):
    """Marginals, expected moves and log of the sum over all label sequences."""
    n, k = emit.shape
    gamma, moved, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            gamma[i, y] += p
        for a, b in zip(path, path[1:]):
            moved[a, b] += p
    return gamma / total, moved / total, np.log(total)


def test_forward_backward_agrees_with_enumeration():
    r = np.random.RandomState(1)
    lengths, k = np.array([6, 4, 4, 1]), 3
    emit, move, start = r.normal(0, 2, (4, 6, k)), r.normal(0, 1, (k, k)), r.normal(0, 1, k)
    gamma, moved, constant = language.forward_backward(emit, lengths, move, start)
    each = [plain(emit[i, :n], move, start) for i, n in enumerate(lengths)]
    for i, n in enumerate(lengths):
        assert np.allclose(gamma[i, :n], each[i][0]) and not gamma[i, n:].any()
    assert np.allclose(moved, sum(x[1] for x in each)) and np.isclose(constant, sum(x[2] for x in each))


def small_field(r, k=3):
    words = ["the", "und", "que", "tion", "ung", "a", "x"]
    field = language.Field(list("abc")[:k], {f: i for i, f in enumerate(sorted({f for w in words for f in language.features_of(w, {})}))}, {})
    field.emit[:], field.move[:], field.start[:] = r.normal(0, 0.7, field.emit.shape), r.normal(0, 1, (k, k)), r.normal(0, 1, k)
    return field, words


def test_slopes_agree_with_differences():
    r = np.random.RandomState(2)
    field, types = small_field(r)
    numbers, edges = field.table(types)
    lengths = np.array([5, 3, 1])
    words, labels = r.randint(0, len(types), (3, 5)), r.randint(0, 3, (3, 5))
    data = (numbers, edges, words, labels, lengths)
    _, *slopes = language.objective(field, *data)
    for weights, slope in zip((field.emit, field.move, field.start), slopes):
        for at in [tuple(r.randint(0, n) for n in weights.shape) for _ in range(12)]:
            keep = weights[at]
            weights[at] = keep + 1e-5
            high = language.objective(field, *data)[0]
            weights[at] = keep - 1e-5
            low = language.objective(field, *data)[0]
            weights[at] = keep
            assert np.isclose((high - low) / 2e-5, slope[at], atol=1e-7)


def test_segments_give_the_marginals_of_one_pass(monkeypatch):
    r = np.random.RandomState(3)
    field, types = small_field(r)
    monkeypatch.setattr(language, "SEGMENT", 4)
    monkeypatch.setattr(language, "AT_ONCE", 30)
    texts = [" ".join(r.choice(types, n)) for n in (1, 3, 4, 5, 8, 9, 37, 2)] + [None, "", "12 34", "²", "the"]
    scorer = language.Scorer(field)
    for text, (words, marginals) in zip(texts, scorer.documents(texts)):
        if not words:
            assert text in (None, "", "12 34", "²")
            continue
        emit = field.emissions(*field.table(words))
        want = language.forward_backward(emit[None], np.array([len(words)]), field.move, field.start)[0][0]
        assert np.allclose(marginals, want, atol=1e-9)


def made(lang, n, r):
    vocabulary = {"xx": ["ka", "tomu", "rikka", "balu", "netti"], "yy": ["sche", "gruft", "planz", "worg", "strum"]}
    return " ".join(r.choice(vocabulary[lang], n))


def test_code_switched_words_and_awkward_rows(spark):
    r = np.random.RandomState(4)
    rows = [(i, made(lang, 40, r), lang) for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    rows += [(1000, made("xx", 30, r) + " " + made("yy", 50, r) + " " + made("xx", 20, r), None), (1001, None, "xx"), (1002, "", "xx"), (1003, "12 + 3", "yy"), (None, made("yy", 9, r), None)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert language.identify(docs).count() == len(rows) + 3
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120]) and got[None]["lang_pred"] == "yy"
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1001, 1002, 1003))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items() if i is not None)
    spans = next(r["spans"] for r in language.language_spans(docs).collect() if r["doc_id"] == 1000)
    assert [(s["lang"], s["first"], s["n_words"]) for s in spans] == [("xx", 0, 30), ("yy", 30, 50), ("xx", 80, 20)]


def test_nothing_to_learn_and_clashing_names(spark):
    docs = spark.createDataFrame([(*r, "en" if i % 2 else None) for i, r in enumerate(awkward())], DOCS + ", lang string")
    done = language.identify(docs)
    assert done.count() == docs.count() and {r["lang_pred"] for r in done.collect()} <= {"en", "und"}
    none = language.identify(docs.withColumn("lang", docs["k1"].substr(9, 1)).filter("doc_id < 0"))
    assert none.count() == 0
    unlabelled = language.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang"))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r["doc_id"]: r for r in language.identify(docs).collect()}
    right = [told[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if told[r["doc_id"]]["held_out"]]
    print(np.mean(right), len(right))
    assert len(right) > 150 and np.mean(right) >= 0.97
