"""Removal of long repeated byte strings by hash refinement at growing offsets.

Every string of ``threshold`` bytes contains an anchor: the leftmost smallest hashed gram of
its first ``window`` grams. Equal strings have their anchors at equal places, so positions
with one anchor form a block and the anchors stand for all positions. Classes of anchors are
refined: Spark numbers the pairs (class so far, hash of the bytes that follow), up to offsets
36, 72 and 145 for 400 bytes; unique anchors drop out each time. This is no prefix doubling,
as no rank of a later position is looked up and the order of the numbers is not used. For
those left, blocks are split into ever smaller ranges of offsets, each ranked by the bytes
that all its strings share (unique: none repeats) and by all bytes its strings cover
(repeated: all repeat), down to single positions. No pairs are formed, and the rows that
are split further are those at the ends of repeated passages.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.session import scratch_table, shuffle_partitions

THRESHOLD = 400
#: Words of a passage, bytes of a word's code where passages are counted in words.
PASSAGE_WORDS, CODE = 50, 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SEGMENT = 1 << 20  # positions looked at together, which bounds the memory for a long text
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Geometry:
    """What follows from the threshold: gram, window, the doubled offsets and the range widths."""

    def __init__(self, threshold: int):
        if threshold < 4:
            raise ValueError("threshold must be at least 4")
        self.threshold = threshold
        self.window = 1 << int(np.log2(threshold * 2 / 3))
        self.gram = min(8, threshold - self.window + 1)
        shared = threshold - self.window + 1
        self.ends = sorted({max(1, shared // 4), max(1, shared // 2), shared})
        self.widths = []
        width = self.window
        while width > 1:
            width = max(1, width // 8)
            self.widths.append(width)


def blocks(body: bytes, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the first and last position of their blocks."""
    positions = len(body) - g.threshold + 1
    if positions <= 0:
        return (np.zeros(0, np.int64),) * 3
    data = np.frombuffer(body, np.uint8)
    anchors, firsts = [], []
    for at in range(0, positions, _SEGMENT):
        n = min(_SEGMENT, positions - at) + g.window - 1
        x = np.zeros(n, np.uint64)
        for i in range(g.gram):
            x = (x << np.uint64(8)) | data[at + i : at + i + n]
        x = (x ^ (x >> np.uint64(31))) * _MULTIPLY
        x = (x ^ (x >> np.uint64(29))) * _MULTIPLY
        x = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step < g.window:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        anchor = (x & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
        change = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        if anchors and anchors[-1][-1] == anchor[0]:
            change = change[1:]
        if len(change):
            anchors.append(anchor[change])
            firsts.append(change + at)
    anchor, first = np.concatenate(anchors), np.concatenate(firsts)
    return anchor, first, np.concatenate([first[1:] - 1, [positions - 1]])


def _name(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def _cover(body: bytes, anchor: int, low: int, high: int, g: Geometry) -> int:
    """Name of all bytes of the strings that begin ``low`` to ``high`` before the anchor."""
    left = max(0, anchor - high)
    return _name((anchor - left).to_bytes(4, "little") + body[left : anchor - low + g.threshold])


def _anchors(docs: DataFrame, g: Geometry) -> DataFrame:
    edges = [0, *g.ends]
    names = ["k1", "k2", "a", "low", "high", "cover", *(f"f{i}" for i in range(len(g.ends)))]

    def rows(c):
        for k1, k2, body in zip(c["k1"], c["k2"], c["body"]):
            for a, first, last in zip(*(x.tolist() for x in blocks(body, g))):
                yield k1, k2, a, a - last, a - first, _cover(body, a, 0, g.window - 1, g), *(_name(body[a + s : a + e]) for s, e in zip(edges, edges[1:]))

    schema = "k1 long, k2 long, a long, low int, high int, cover long, " + ", ".join(f"{n} long" for n in names[6:])
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * (1 + len(g.ends))
    return map_rows(docs.select("k1", "k2", "body"), schema, rows, names, types, 100_000)


def _reranked(rows: DataFrame, following: str) -> DataFrame:
    """``rows`` whose (rank, following) is not unique, with the place of that pair in the sorted
    order as their new rank."""
    pairs = rows.groupBy("rank", following).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    in_order = pairs.repartitionByRange(shuffle_partitions(rows.sparkSession), "rank", following).sortWithinPartitions("rank", following)
    ranks = scratch_table(in_order.withColumn("next", F.monotonically_increasing_id()), "suffix-ranks")
    joined = rows.join(ranks, ["rank", following])
    return scratch_table(joined.drop("rank", following).withColumnRenamed("next", "rank"), "suffix-rows")


def _decided(rows: DataFrame, group: list[str], more: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows that repeat in all their strings, and those to be split further.

    ``rows``: (k1, k2, a, low, high, known, ``group``, cover). Rows of one group share what is
    common to their strings, rows of one cover share everything. Of a cover met twice one
    row goes on, as known, if its group has other covers that may meet parts of it.
    """
    covers = scratch_table(
        rows.groupBy(*group, "cover").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"), F.min(F.struct("k1", "k2", "a", "low", "high")).alias("one")), "suffix-covers"
    )
    twice = covers.filter("n > 1").select(*group, "cover")
    repeated = rows.filter("NOT known").join(twice, [*group, "cover"], "left_semi")
    if not more:
        return repeated, None
    mixed = covers.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    onward = covers.join(mixed, group, "left_semi").select(*group, "one.*", (F.col("known") | (F.col("n") > 1)).alias("known"))
    return repeated, onward


def _split(texts: DataFrame, active: DataFrame, width: int, g: Geometry) -> DataFrame:
    """The active rows cut into offset ranges of ``width``, with new names."""
    item = F.struct("a", "low", "high", "known", "class", "at", "span")
    per_document = scratch_table(active.groupBy("k1", "k2").agg(F.collect_set(item).alias("items")), "suffix-active")

    def rows(c):
        for k1, k2, body, items in zip(c["k1"], c["k2"], c["body"], c["items"]):
            for x in items:
                a, low, high = x["a"], x["low"], x["high"]
                for at in range(max(x["at"], low) // width * width, min(x["at"] + x["span"] - 1, high) + 1, width):
                    end = at + width - 1
                    yield k1, k2, a, max(low, at), min(high, end), x["known"], x["class"], at, _name(body[a - at : a - end + g.threshold]), _cover(body, a, at, end, g)

    names = ["k1", "k2", "a", "low", "high", "known", "class", "at", "shared", "cover"]
    schema = "k1 long, k2 long, a long, low int, high int, known boolean, class long, at int, shared long, cover long"
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    joined = texts.join(per_document, ["k1", "k2"])
    return scratch_table(map_rows(joined, schema, rows, names, types, 100_000), "suffix-split")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(k1, k2, spans) for documents with any: sorted maximal runs [start, stop) of bytes that
    lie in a string of ``threshold`` bytes that begins at another place too.

    Keys are those of ``common.keyed``; repeated rows are documents of their own and repeat
    each other. Texts shorter than the threshold, null and empty ones have no spans.
    """
    return _spans(keyed(docs).select("k1", "k2", "body"), threshold)


def _spans(texts: DataFrame, threshold: int) -> DataFrame:
    """``repeated_spans`` of the bytes in (k1, k2, body)."""
    g = Geometry(threshold)
    rows = scratch_table(_anchors(texts, g), "suffix-anchors").withColumn("rank", F.lit(0).cast("long"))
    for i in range(len(g.ends)):
        rows = _reranked(rows, f"f{i}")
    rows = rows.withColumn("known", F.lit(False)).withColumnRenamed("rank", "class")
    repeated, active = _decided(rows, ["class"], bool(g.widths))
    found = [repeated]
    active = active.withColumns({"at": F.lit(0), "span": F.lit(g.window)})
    mixed = scratch_table(active, "suffix-mixed")
    holders = scratch_table(mixed.select("k1", "k2").distinct(), "suffix-holders")
    texts = scratch_table(join_checked(texts, holders, ["k1", "k2"], "inner"), "suffix-texts")
    active = mixed
    for width in g.widths:
        pieces = _split(texts, active, width, g)
        repeated, active = _decided(pieces, ["class", "at", "shared"], width > 1)
        found.append(repeated)
        if active is not None:
            active = active.withColumn("class", F.xxhash64("class", "at", "shared")).withColumn("span", F.lit(width)).drop("shared")
    spans = None
    for part in found:
        part = part.select("k1", "k2", (F.col("a") - F.col("high")).alias("start"), (F.col("a") - F.col("low") + threshold).alias("stop"))
        spans = part if spans is None else spans.unionByName(part)

    def merge(batches):
        for batch in batches:
            merged = []
            for items in batch.column(2).to_pylist():
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in items):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                merged.append([x for r in runs for x in r])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(merged, pa.list_(pa.int64()))], names=["k1", "k2", "spans"])

    grouped = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("items"))
    return scratch_table(grouped.mapInArrow(merge, "k1 long, k2 long, spans array<long>"), "suffix-spans")


def _rest(body: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return body
    edges = [0, *spans, len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, threshold: int) -> DataFrame:
    return join_checked(keyed(docs), repeated_spans(docs, threshold), ["k1", "k2"], "left", 40 + 8 * F.size("spans"))


def removed(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(k1, k2, doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``;
    ``n_bytes`` is the UTF-8 length before removal. A text that is null, or removed whole,
    counts as empty."""

    def rows(c):
        for k1, k2, doc, body, spans in zip(c["k1"], c["k2"], c["doc_id"], c["body"], c["spans"]):
            spans = spans or []
            rest = _rest(body, spans)
            yield k1, k2, doc, len(body), len(body) - len(rest), len(spans) // 2, hashlib.sha256(rest).hexdigest()

    names = ["k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    joined = _with_spans(docs, threshold).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body", "spans")
    return map_rows(joined, "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows, names, [pa.int64()] * 6 + [pa.string()])


def dedup_passages(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the same columns and rows, texts without their repeated spans. Bytes of a
    character that a span cuts through go with it; a null text stays null."""

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_rest(bytes(b), None if s is None else list(s)).decode("utf-8", "ignore") for b, s in zip(bodies, spans)], dtype=object)

    joined = _with_spans(docs, threshold)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut("body", "spans"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def coded(body: bytes) -> bytes:
    """Four bytes for each word: equal words, equal codes."""
    return b"".join([xxhash.xxh32_digest(w) for w in body.split()])


def without_words(body: bytes, spans: list[int]) -> bytes:
    """The text without the words whose codes lie whole in ``spans``, each run of them with the
    white space after it."""
    starts = [m.start() for m in _WORD.finditer(body)] + [len(body)]
    rest, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        first, stop = -(-a // CODE), b // CODE
        if first < stop:
            rest.append(body[at : starts[first]])
            at = starts[stop]
    return b"".join(rest) + body[at:]


def dedup_word_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with the same columns and rows, texts without their repeated passages of words.

    A word goes if it lies in a sequence of ``words`` words that also begins anywhere else, in the
    same document or another; however many bytes the words have and whatever white space
    separates them. Words are what white space of ASCII separates, upper case counts. A text may
    become empty; null texts stay null, texts of fewer words stay as they are. The search is that
    for bytes, over a code of four bytes for each word (sequences of other words have equal codes
    with a probability of 2^-32 for each word in which they differ).
    """

    def codes(c):
        for k1, k2, body in zip(c["k1"], c["k2"], c["body"]):
            yield k1, k2, coded(body)

    plain = keyed(docs).select("k1", "k2", "body")
    texts = scratch_table(map_rows(plain, "k1 long, k2 long, body binary", codes, ["k1", "k2", "body"], [pa.int64(), pa.int64(), pa.binary()], 2000), "suffix-codes")

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_words(bytes(b), [] if s is None else list(s)).decode() for b, s in zip(bodies, spans)], dtype=object)

    joined = join_checked(keyed(docs), _spans(texts, words * CODE), ["k1", "k2"], "left", 40 + 8 * F.size("spans"))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut("body", "spans"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
