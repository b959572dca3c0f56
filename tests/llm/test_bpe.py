"""Ids and decoded texts against the tokenizers library, with chunks small enough to be shared."""

import timeit

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidence_spark.llm import bpe
from llm_cases import DOCS, awkward

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["Ab's ΣΑΣ don't x Y \x1cz!\x1c! <|startoftext|>a<|endoftext|> é İ ﬁ ½3²", "\x85á ̈́b", "x" * 3000, "日本 語　123,456"])
def test_words_alone_give_the_library_ids(text):
    e, model = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    want = model.encode(text, add_special_tokens=False).ids
    assert list(memoryview(e.ids(text.encode())).cast("I")) == want
    assert e.decode(e.ids(text.encode())) == model.decode(want, skip_special_tokens=False)


def test_documents_agree_with_the_library(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    model = Tokenizer.from_file(PATH)
    want = {r[0]: model.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["ids"] == want[r["doc_id"]] and r["decoded"] == model.decode(want[r["doc_id"]], skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_joins_are_repaired():
    shared = " ".join(f"shared{i} words-{i}" for i in range(600))
    e = bpe.Encoder(PATH)
    for body in (shared, "pre" + shared + "post", "ü " + shared, "x" * 500 + shared):
        body = body.encode()
        edges = [*bpe.cuts(body), len(body)]
        assert len(edges) > 3
        ids = {}
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            first, last = bpe.core(body[a:b])
            if first < last and i % 3 != 1:
                ids[i] = e.ids(body[a + first : a + last])
        assert ids and bpe.assemble(body, ids, e) == e.ids(body)


def _plain_cuts(body):
    """Gram by gram, byte after byte."""
    found, data = [0], np.frombuffer(body, np.uint8)
    n = max(0, len(body) - bpe.GRAM)
    x = np.zeros(n, np.uint64)
    for i in range(bpe.GRAM):
        x = (x << np.uint64(8)) | data[i : i + n]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    for c in (np.flatnonzero((x >> np.uint64(40)) & np.uint64(bpe.MEAN - 1) == 0) + bpe.GRAM).tolist():
        while c < len(body) and body[c] & 0xC0 == 0x80:
            c += 1
        if c - found[-1] >= bpe.LEAST and c < len(body):
            found.append(c)
    return found


def test_cuts_equal_a_plain_search_in_less_time():
    body = "".join(f"w{i * 2654435761 % 1000003} é " for i in range(80_000)).encode()
    for text in (b"", b"x" * 8, b"x" * 9, body[:5000], body):
        assert bpe.cuts(text) == _plain_cuts(text)
    took = lambda f: min(timeit.repeat(lambda: f(body), number=1, repeat=7))
    assert took(bpe.cuts) < 0.75 * took(_plain_cuts)
