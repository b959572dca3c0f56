"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash cuts texts where their content says so, so equal passages get equal chunks.
Chunks found more than once are encoded once, by one of the documents that hold them; all
others are encoded where they are. At a join the ids next to it may be wrong, as merges do
not stop at a cut: the text around it is encoded again, reaching outwards until both ends
agree exactly with a whole encoding. That is so at ASCII white space, which the vocabulary's
pattern never crosses, so a chunk's ids are kept only between its first and last white space.
"""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.session import scratch_table

GRAM, MEAN, LEAST = 8, 2048, 128
_SEGMENT = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\x0b\x0c\r"
_CACHE = 400_000  # words remembered by a worker


def cuts(body: bytes) -> list[int]:
    """Where chunks begin, 0 included: after 8-byte grams whose hash has its low bits zero, at
    least ``LEAST`` bytes after the cut before, at the start of a character."""
    found = [0]
    for at in range(0, len(body) - GRAM, _SEGMENT):
        n = min(_SEGMENT, len(body) - GRAM - at)
        # a gram is eight bytes read as one number, at every place of the text
        x = np.ndarray((n,), ">u8", body, at, (1,)).astype(np.uint64)
        x ^= x >> np.uint64(31)
        x *= _MULTIPLY
        x >>= np.uint64(40)
        x &= np.uint64(MEAN - 1)
        for c in (np.flatnonzero(x == 0) + at + GRAM).tolist():
            while c < len(body) and body[c] & 0xC0 == 0x80:
                c += 1
            if c - found[-1] >= LEAST and c < len(body):
                found.append(c)
    return found


def core(chunk: bytes) -> tuple[int, int]:
    """First and last white space of a chunk, (-1, -1) without any."""
    places = [p for p in (chunk.find(c) for c in _WHITE) if p >= 0]
    return (min(places), max(chunk.rfind(c) for c in _WHITE)) if places else (-1, -1)


class Encoder:
    """The library's ids of texts, word by word; words are remembered up to a fixed number."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.tokens = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}

    def ids(self, body: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text or of a part between white space."""
        words = body.split()
        if len(self.known) > _CACHE:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for word, e in zip(new, self.model.encode_batch_fast([w.decode() for w in new], add_special_tokens=False) if new else []):
            found = e.ids
            self.known[word] = struct.pack(f"<{len(found)}I", *found)
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False) of a vocabulary file without a decoder."""
        if self.model.decoder is not None:
            return self.model.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def assemble(body: bytes, shared: dict[int, bytes], encoder: Encoder) -> bytes:
    """The ids of a text from those of its shared chunks (by number) and of all else."""
    if not shared:
        return encoder.ids(body)
    edges = [*cuts(body), len(body)]
    out, open_from = [], 0
    for number, ids in sorted(shared.items()):
        start = edges[number]
        first, last = core(body[start : edges[number + 1]])
        # from the last point of agreement to the chunk's first white space: over the join
        out.append(encoder.ids(body[open_from : start + first]))
        out.append(ids)
        open_from = start + last
    out.append(encoder.ids(body[open_from:]))
    return b"".join(out)


def _chunks(texts: DataFrame) -> DataFrame:
    def rows(c):
        for k1, k2, body in zip(c["k1"], c["k2"], c["body"]):
            edges = [*cuts(body), len(body)]
            for number, (a, b) in enumerate(zip(edges, edges[1:])):
                first, last = core(body[a:b])
                if first < last:  # something lies between
                    name = xxhash.xxh3_128_digest(body[a:b])
                    yield k1, k2, number, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)

    names = ["k1", "k2", "number", "h1", "h2"]
    return map_rows(texts, "k1 long, k2 long, number int, h1 long, h2 long", rows, names, [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2)


def _encoded_once(texts: DataFrame, wanted: DataFrame, vocabulary: str) -> DataFrame:
    """(h1, h2, ids) of the chunks that one of their documents was chosen to encode."""
    held: dict = {}

    def rows(c):
        if "e" not in held:
            held["e"] = Encoder(vocabulary)
        for body, items in zip(c["body"], c["items"]):
            edges = [*cuts(body), len(body)]
            for x in items:
                chunk = body[edges[x["number"]] : edges[x["number"] + 1]]
                first, last = core(chunk)
                yield x["h1"], x["h2"], _narrow(held["e"].ids(chunk[first:last]))

    per_document = scratch_table(wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "h1", "h2")).alias("items")), "bpe-wanted")
    joined = join_checked(texts, per_document, ["k1", "k2"], "inner", 32 + 24 * F.size("items"))
    # repeated rows share their key and would encode the chunk each
    return map_rows(joined, "h1 long, h2 long, ids binary", rows, ["h1", "h2", "ids"], [pa.int64(), pa.int64(), pa.binary()], 5000).dropDuplicates(["h1", "h2"])


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit, with a mark in front."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids[1:], "<u2").astype("<u4").tobytes() if ids[:1] == b"\2" else ids[1:]


def _assembled(docs: DataFrame, vocabulary: str, finish, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    texts = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body")
    chunks = scratch_table(_chunks(texts.select("k1", "k2", "body")), "bpe-chunks")
    one = F.min(F.struct("k1", "k2", "number")).alias("one")
    shared = scratch_table(chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), one).filter("n > 1").select("h1", "h2", "one.*"), "bpe-shared")
    encoded = scratch_table(_encoded_once(texts, shared, vocabulary), "bpe-encoded")
    uses = join_checked(chunks, encoded, ["h1", "h2"], "inner", 32 + F.length("ids"))
    needs = scratch_table(uses.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "ids")).alias("shared")), "bpe-needs")
    having = scratch_table(needs.select("k1", "k2"), "bpe-having")
    held: dict = {}

    def rows(c):
        if "e" not in held:
            held["e"] = Encoder(vocabulary)
        for k1, k2, doc, body, items in zip(c["k1"], c["k2"], c["doc_id"], c["body"], c["shared"]):
            ids = assemble(body, {x["number"]: _wide(x["ids"]) for x in items or []}, held["e"])
            yield k1, k2, doc, *finish(ids, held["e"])

    # only documents with shared chunks are shuffled to meet the ids; the others are encoded where they are read
    size = 32 + F.expr("aggregate(shared, 0L, (s, x) -> s + 16 + length(x.ids))")
    met = join_checked(join_checked(texts, having, ["k1", "k2"], "left_semi"), needs, ["k1", "k2"], "inner", size)
    alone = join_checked(texts, having, ["k1", "k2"], "left_anti").withColumn("shared", F.lit(None).cast(needs.schema["shared"].dataType))
    return map_rows(met.select(*alone.columns).unionByName(alone), "k1 long, k2 long, doc_id long, " + schema, rows, ["k1", "k2", "doc_id", *names], [pa.int64()] * 3 + types, 200)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(k1, k2, doc_id, ids, decoded): the library's ids of each text, as an array, and its
    decoding of them. A null or empty text has none; repeated rows have equal results."""
    finish = lambda ids, e: (np.frombuffer(ids, "<u4").tolist(), e.decode(ids))
    return _assembled(docs, vocabulary, finish, "ids array<long>, decoded string", ["ids", "decoded"], [pa.list_(pa.int64()), pa.string()])


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode``, but (k1, k2, doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    finish = lambda ids, e: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest())
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _assembled(docs, vocabulary, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", names, [pa.int64(), pa.string(), pa.string()])
