"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from evidence_spark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, node int, kind string"


def expected(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0 if children.get(p) else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for q in children.get(p, []):
            more = below(q)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    for p, who in members.items():
        told = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), *below(p), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, most=8):
    r = random.Random(seed)
    said = ["", "hi", "hé", "how are you", "x" * 300, None]
    rows = []
    for c in range(-7, n):
        if r.random() < 0.1:
            continue
        common = r.random() < 0.3
        for t in range(r.randint(1, most)):
            role = "user" if common else r.choice(["user", "assistant", None, "u"])
            text = "how are you" if common else r.choice(said)
            rows.append((c, None if r.random() < 0.05 else t, role, text, "p", 1, None))
    return rows + [(None, 1, "user", "lost", "", 1, ""), (None, None, None, None, None, None, None)]


@pytest.mark.parametrize("shards", [1, 7, 60])
@pytest.mark.parametrize("n,most", [(40, 8), (300, 3), (120, 30)])
def test_agrees_with_all_prefixes(spark, shards, n, most):
    rows = conversations(n, n + shards, most)
    found = prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), shards)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_copies_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(c, t, "user", f"turn {t}", "", 0, "") for c in range(400) for t in range(6 if c % 3 else 9)]
    found = prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), 25)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_sql_gives_the_same(spark):
    import pandas as pd

    rows = conversations(60, 1)
    conversations_ = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations_)
    got = [tuple(r) for r in con.sql(prefix_trie.SQL).fetchall()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table_and_single_turn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.nodes(prefix_trie.rebuilt(empty)).count() == 0
    one = [(3, None, None, None, None, None, None)]
    assert sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(one, SCHEMA))).collect()), key=str) == expected(one)
