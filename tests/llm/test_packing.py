"""Pieces against the tokenizers library; sequences are gapless, whole and few."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidence_spark.llm import packing
from evidence_spark.session import scratch_table
from llm_cases import DOCS, awkward

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_places(spark):
    rows = awkward(30)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    packed = packing.pack(scratch_table(packing.pieces(docs, PATH), "test-pieces")).collect()
    model = Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x for _, x in places[:i]) for i in range(len(places))]
        assert sum(x for _, x in places) <= 2048
    assert packing.pack(scratch_table(packing.pieces(docs.limit(0), PATH), "test-pieces")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_and_wastes_little(seed):
    r = random.Random(seed)
    lengths = Counter(min(100, max(1, int(r.lognormvariate(3, 0.8)))) for _ in range(3000))
    patterns = packing.plan(dict(lengths), 100)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 100 and times > 0
        for x in pattern:
            used[x] += times
    assert used == lengths
    total = sum(k * n for k, n in lengths.items())
    assert sum(t for _, t in patterns) <= -(-total // 100) + 2


def test_two_replace_the_smallest():
    # filled greedily 60 + 30 leaves 10 empty; 20 and 19 in place of 30 leave one
    assert packing.plan({60: 1, 30: 1, 20: 1, 19: 1}, 100)[0] == ([60, 20, 19], 1)


def test_many_pieces_of_one_length_take_few_steps():
    assert len(packing.plan({2048: 10**12, 700: 10**12, 3: 10**11, 1: 7}, 2048)) < 60
