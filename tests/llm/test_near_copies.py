"""Near copies against all pairs of five-word shingle sets in plain Python."""

import random
import re

from evidence_spark.llm import near_copies
from llm_cases import DOCS, awkward


def grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_links(texts):
    """Pairs of different sets at 0.8 or more, with their similarity."""
    sets = sorted({grams(t) for t in texts}, key=sorted)
    pairs = ((a, b, similarity(a, b)) for i, a in enumerate(sets) for b in sets[:i] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)))
    return [(a, b, s) for a, b, s in pairs if s >= 0.8]


def plain_classes(texts, links):
    parent = {grams(t): grams(t) for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in links:
        parent[find(a)] = find(b)
    return {s: find(s) for s in parent}


def edited(r, words, many):
    words = list(words)
    for at in r.sample(range(len(words)), many):
        words[at] = "x" + str(r.randrange(10**6))
    return words


def planted(seed, groups=120):
    """Base texts of 40 to 400 words with one or two copies of a similarity from below 0.8 to 1."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(40, 400))]
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 2)):
            texts.append(" ".join(edited(r, base, max(1, round(len(base) * r.uniform(0.002, 0.03))))))
    return texts


def found(spark, rows):
    return near_copies.classes(spark.createDataFrame(rows, DOCS).repartition(6)).collect()


def test_planted_copies_are_met_and_others_left_alone(spark):
    texts = planted(5)
    rows = [(i, t, "en", i, "s", 1) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in found(spark, rows)}
    links = plain_links(texts)
    place = {}
    for i, t in enumerate(texts):
        place.setdefault(grams(t), i)
    met = [got[place[a]] == got[place[b]] for a, b, _ in links]
    low = [m for m, (_, _, s) in zip(met, links) if s < 0.85]
    high = [m for m, (_, _, s) in zip(met, links) if s >= 0.85]
    assert len(low) > 20 and sum(low) >= 0.85 * len(low) and sum(high) >= 0.97 * len(high)
    truth = plain_classes(texts, links)
    for i, t in enumerate(texts):
        assert truth[grams(t)] == truth[grams(texts[got[i]])]


def test_large_groups_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "DENSE", 3)
    r = random.Random(6)
    bases = [["w" + str(r.randrange(10**6)) for _ in range(200)] for _ in range(3)]
    texts = [" ".join(edited(r, b, r.randint(0, 3))) for b in bases for _ in range(60)]
    rows = [(i, t, "en", i, "s", 1) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in found(spark, rows)}
    truth = plain_classes(texts, plain_links(texts))
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(truth[grams(t)], i)
    assert got == {i: least[truth[grams(t)]] for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    rows = awkward()
    got = sorted(((str(x["doc_id"]), x["component_id"]) for x in found(spark, rows)), key=str)
    texts = [x[1] for x in rows]
    truth = plain_classes(texts, plain_links(texts))
    least = {}
    for x in rows:
        if x[0] is not None:
            least[truth[grams(x[1])]] = min(x[0], least.get(truth[grams(x[1])], x[0]))
    assert got == sorted(((str(x[0]), least.get(truth[grams(x[1])])) for x in rows), key=str)
    docs = spark.createDataFrame(rows, DOCS)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(truth.values()))
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_pairs_within_a_component_and_of_other_sizes_are_not_compared(spark, monkeypatch):
    stored, plain = {}, near_copies.scratch_table
    monkeypatch.setattr(near_copies, "scratch_table", lambda df, label: stored.setdefault(label, []).append(plain(df, label)) or stored[label][-1])
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 400, 33)]  # all of one component
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.classes(docs).select("component_id").distinct().count() == 1
    assert sum(t.count() for t in stored["copies-pairs"]) < len(texts) * (len(texts) - 1) // 2
    rows = [(1, 10, 0, 100), (1, 11, 0, 79), (1, 12, 0, 126), (1, 13, 0, 40)]
    few = spark.createDataFrame(rows, "sig long, node long, bits long, size long")
    met = near_copies._between(few, few.select("node", few.node.alias("label")))
    assert {(x.a, x.b) for x in met.collect()} == {(10, 11), (10, 12)}


def test_signatures_of_two_texts_need_no_join(spark, monkeypatch):
    stored, plain = {}, near_copies.scratch_table
    monkeypatch.setattr(near_copies, "scratch_table", lambda df, label: stored.setdefault(label, []).append(plain(df, label)) or stored[label][-1])
    r = random.Random(11)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(300)] for _ in range(20)]
    texts = [" ".join(t) for b in bases for t in (b, edited(r, b, 3))]
    got = {x["doc_id"]: x["component_id"] for x in found(spark, [(i, t, "en", i, "s", 1) for i, t in enumerate(texts)])}
    assert got == {i: i - i % 2 for i in range(40)}
    assert stored["copies-shared"][0].count() > 20 and stored["copies-members"][0].count() == 0
    rows = [(1, 10, 0), (1, 11, -1), (2, 12, 0), (2, 10, 3), (3, 10, 0), (3, 11, -1), (3, 12, 5), (4, 10, 0)]
    shared = near_copies._shared(spark.createDataFrame(rows, "sig long, node long, bits long"))
    assert {tuple(x) for x in shared.collect()} == {(2, 2, 10, 12), (3, 3, 10, 12)}


def test_longer_segments_for_more_texts_meet_as_many_copies(spark, monkeypatch):
    for texts in (0, 1, 1 << 20):
        assert near_copies.segments(texts).tolist() == [[21 * i + j for j in range(21)] for i in range(15)]
    for doublings in (1, 4, 10):
        places = near_copies.segments(near_copies.PLENTY << doublings)
        assert places.shape[1] == 21 + doublings and all(len(set(p)) == len(p) and max(p) < 320 for p in places.tolist())
    texts = planted(5)
    monkeypatch.setattr(near_copies, "PLENTY", len(texts) >> 5)
    got = {x["doc_id"]: x["component_id"] for x in found(spark, [(i, t, "en", i, "s", 1) for i, t in enumerate(texts)])}
    place = {}
    for i, t in enumerate(texts):
        place.setdefault(grams(t), i)
    links = plain_links(texts)
    met = [(got[place[a]] == got[place[b]], s) for a, b, s in links]
    low, high = [m for m, s in met if s < 0.85], [m for m, s in met if s >= 0.85]
    assert len(low) > 20 and sum(low) >= 0.85 * len(low) and sum(high) >= 0.97 * len(high)
    truth = plain_classes(texts, links)
    assert all(truth[grams(t)] == truth[grams(texts[got[i]])] for i, t in enumerate(texts))
