"""Near copies by five-word shingles with a Jaccard similarity of 0.8 or more, found by SimHash.

At similarity 0.8 about 15 of 100 SimHash bits differ, too many for the few segments of one 64-bit
fingerprint. So a text has 15 segments of 21 bits, and a pair is a candidate where one segment
differs by at most one bit: it then agrees in a segment with that bit left out. Left out are only the
six bits of a segment whose votes were closest, as these are the ones that flip. Candidates are
compared on 64 further bits, in large groups on all bits, and then verified by their whole shingle sets, so each link is true.
Of pairs at 0.8 the segments meet about 0.9, of pairs at 0.9 nearly all. Beyond a million texts the
segments grow longer with the number of texts, and more, so that as few texts share one by chance
and as many near copies do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.llm.components import components
from evidence_spark.llm.simhash import keep_one
from evidence_spark.session import scratch_table

WORDS, SEED = 5, 42
SEGMENTS, WIDTH, SOFT = 15, 21, 6
#: For up to so many texts; a segment has a bit more for each doubling. Share of bits that differ at 0.8.
PLENTY, FLIPS = 1 << 20, 0.15
#: At similarity 0.8 about 10 of 64 bits differ, with a deviation of 3, and 58 of 384, with one of 7.
REACH, REACH_ALL = 20, 76
#: Signatures shared by more texts, which chance alone does not bring about, are searched through centres first.
DENSE, CENTRES, TURNS = 16, 8, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
#: 64 more bits of a shingle for each: five for the segments, the last to compare candidates.
_LANES = np.array([xxhash.xxh64_intdigest(b"lane", seed) | 1 for seed in range(6)], np.uint64)
_PLACE = np.arange(48, dtype=np.int64) * 256


def shingles(body: bytes) -> np.ndarray:
    """The distinct hashes of all shingles in order; one for a text of fewer words, none without words."""
    parts = body.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = max(1, len(parts) - WORDS + 1)
    starts = [0, *(ends[: last - 1] + 1).tolist()]
    stops = ends[min(WORDS, len(parts)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, last))


def segments(texts: int) -> np.ndarray:
    """The places of the bits of each segment among the first 320, for so many texts. Segments
    too many or too long to lie side by side each have their own choice of bits."""
    width = WIDTH + max(0, math.ceil(math.log2(max(1, texts) / PLENTY)))
    meet = lambda w: (1 - FLIPS) ** w + w * FLIPS * (1 - FLIPS) ** (w - 1)
    many = math.ceil(SEGMENTS * meet(WIDTH) / meet(width))
    if many * width <= 320:
        return np.arange(many * width).reshape(many, width)
    order = [sorted(range(320), key=lambda bit: xxhash.xxh64_intdigest(bit.to_bytes(2, "little"), s)) for s in range(many)]
    return np.array(order)[:, :width]


def sketch(found: np.ndarray, places: np.ndarray) -> tuple[int, list[int], list[int]]:
    """(node, words, sigs) of a shingle set: its identity, its 384 bits, six signatures for each
    of the ``segments``. A set without shingles is node 0 and has no signature."""
    if not len(found):
        return 0, [0] * 6, []
    counts = np.zeros(48 * 256, np.int64)
    for at in range(0, len(found), 65536):
        mixed = found[at : at + 65536, None] * _LANES
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _LANES[::-1]
        mixed ^= mixed >> np.uint64(29)
        counts += np.bincount((mixed.astype(">u8").view(np.uint8).reshape(-1, 48) + _PLACE).ravel(), minlength=48 * 256)
    votes = 2 * (counts.reshape(48, 256).astype(np.float32) @ _BITS).ravel().astype(np.int64) - len(found)
    ones = votes > 0
    many, width = places.shape
    powers = 1 << np.arange(width, dtype=np.int64)
    value = ones[places] @ powers
    soft = np.argsort(np.abs(votes[places]), axis=1, kind="stable")[:, :SOFT]
    number = np.arange(many)[:, None] * width + soft
    sigs = (number << width) | (value[:, None] & ~powers[soft])
    words = np.packbits(ones).view(">i8").tolist()
    node = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return node - (1 << 64) if node >> 63 else node, words, sigs.ravel().tolist()


def _sketches(docs: DataFrame) -> DataFrame:
    places = segments(docs.count())

    def rows(c):
        for k1, k2, doc, body in zip(c["k1"], c["k2"], c["doc_id"], c["body"]):
            found = shingles(body)
            yield k1, k2, doc, len(found), *sketch(found, places)

    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body")
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    return map_rows(plain, "k1 long, k2 long, doc_id long, size long, node long, words array<long>, sigs array<long>", rows, ["k1", "k2", "doc_id", "size", "node", "words", "sigs"], types, 5000)


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams): the whole shingle set of each wanted node, from one text that has it."""
    first = scratch_table(nodes.join(wanted, "node", "left_semi").select("node", "first.k1", "first.k2"), "copies-wanted")
    texts = join_checked(keyed(docs).select("k1", "k2", "body"), first, ["k1", "k2"], "inner").select("node", "body")

    def rows(c):
        for node, body in zip(c["node"], c["body"]):
            yield node, shingles(body).view(np.int64).tolist()

    found = map_rows(texts, "node long, grams array<long>", rows, ["node", "grams"], [pa.int64(), pa.list_(pa.int64())], 200)
    return scratch_table(found.dropDuplicates(["node"]), "copies-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) whose shingle sets have a Jaccard similarity of 0.8 or more."""
    one, two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    both = join_checked(pairs, one, ["b"], "inner", 16 + 8 * F.size("gb"))
    both = join_checked(both, two, ["a"], "inner", 16 + 8 * F.size("ga"))
    return scratch_table(both.filter("9 * size(array_intersect(ga, gb)) >= 4 * (size(ga) + size(gb))").select("la", "lb").distinct(), "copies-links")


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` after the labels that a link (la, lb) joins have become the smallest of them."""
    same = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "label")
    others = [c for c in rows.columns if c != "label"]
    return rows.join(same, "label", "left").select(*others, F.coalesce("component", "label").alias("label"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label), stored, after ``_relabelled``."""
    return scratch_table(_relabelled(labels, links), "copies-labels")


def _mixed(members: DataFrame) -> DataFrame:
    """(sig, node, words, label, largest) of the signatures whose members still have several labels."""
    counted = members.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n"))
    several = counted.groupBy("sig").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    return scratch_table(members.join(several.drop("labels"), "sig"), "copies-mixed")


def _apart(x: Column, y: Column) -> Column:
    """How many of the 384 bits differ."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(6)), F.lit(0))


def _to_centres(mixed: DataFrame, turn: int) -> DataFrame:
    """(a, b, la, lb): each member with the nearest centre of another label over its signatures; in
    later turns only those outside the largest component of a signature."""
    order = [F.xxhash64(F.lit(turn * CENTRES + i), F.col("node")) for i in range(CENTRES)]
    centres = mixed.groupBy("sig").agg(*(F.min_by(F.struct("node", "words", "label"), o).alias(f"c{i}") for i, o in enumerate(order)))
    centres = centres.select("sig", F.array(*(f"c{i}" for i in range(CENTRES))).alias("centres"))
    reach = F.filter("centres", lambda c: (c["label"] != F.col("label")) & (_apart(c["words"], F.col("words")) <= REACH_ALL))
    near = F.array_min(F.transform(reach, lambda c: F.struct(_apart(c["words"], F.col("words")).alias("far"), c["node"].alias("b"), c["label"].alias("lb"))))
    asking = mixed if turn == 0 else mixed.filter("label <> largest")
    met = asking.join(centres, "sig").select("node", "label", near.alias("near")).filter("near IS NOT NULL")
    best = met.groupBy("node", "label").agg(F.min("near").alias("near"))
    return best.select(F.col("node").alias("a"), "near.b", F.col("label").alias("la"), "near.lb")


def _rest(mixed: DataFrame) -> DataFrame:
    """(a, b, la, lb): per signature, what is outside its largest component with all of other components."""
    left = mixed.filter("label <> largest").select("sig", F.col("node").alias("a"), F.col("words").alias("x"), F.col("label").alias("la"))
    right = mixed.select("sig", F.col("node").alias("b"), F.col("words").alias("y"), F.col("label").alias("lb"), "largest")
    apart = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("largest")) | (F.col("a") < F.col("b")))
    return left.join(right, "sig").filter(apart & (_apart(F.col("x"), F.col("y")) <= REACH_ALL)).select("a", "b", "la", "lb").distinct()


def _close(x: str, y: str) -> Column:
    return F.expr(f"bit_count({x} ^ {y}) <= {REACH}")


def _with_first(few: DataFrame) -> DataFrame:
    """(a, b): each member of a signature with its first one, so there are no more rows than members."""
    first = F.min(F.struct("node", "bits")).over(Window.partitionBy("sig"))
    first = few.select(first.alias("first"), F.col("node").alias("b"), F.col("bits").alias("y"))
    first = first.select(F.col("first.node").alias("a"), F.col("first.bits").alias("x"), "b", "y")
    return first.filter((F.col("a") < F.col("b")) & _close("x", "y")).select("a", "b")


def _shared(sigs: DataFrame) -> DataFrame:
    """(sig, n, a, b), stored: signatures of several texts with the first and the last one. Of two
    texts this is the pair, and ``apart`` is what differs between them, so those that are
    not near copies, which most that meet by chance are, leave without a join."""
    counted = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("bits").alias("apart"))
    return scratch_table(counted.filter(f"n > 2 OR n = 2 AND bit_count(apart) <= {REACH}").drop("apart"), "copies-shared")


def _between(few: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, la, lb): all pairs of members of a signature that have different labels. A signature
    within one component has no row. Sets at 0.8 or more differ in size by a quarter at most, so
    only those of the same or a neighbouring step of size meet: texts that share a signature by
    chance, whose number grows with the square of the texts, mostly do not."""
    known = few.select("sig", "node", "bits", F.floor(F.log("size") / F.lit(math.log(1.26))).alias("step"))
    known = scratch_table(known.join(labels, "node"), "copies-known")
    several = known.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("sig")
    known = scratch_table(known.join(several, "sig", "left_semi"), "copies-several")
    left, right = (known.select("sig", "step", F.col("node").alias(n), F.col("bits").alias(x), F.col("label").alias(f"l{n}")) for n, x in (("a", "x"), ("b", "y")))
    left = left.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    pairs = left.join(right, ["sig", "step"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _close("x", "y"))
    return scratch_table(pairs.select("a", "b", "la", "lb").distinct(), "copies-pairs")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _labels(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the components of all verified links.

    Signatures of one text leave after one count, and those of two are pairs by then. In those that
    few share, each text is first held
    against the first one; then all pairs of texts that this left in different components are.
    Pairs within a component could join nothing more. Of
    the others each text is held against the nearest centre, one pair a text, then once more what is
    outside a signature's largest component; what still is, is compared with the other
    components. A signature within one component has no rows any more.
    """
    sigs = nodes.select("node", "size", F.col("words")[5].alias("bits"), F.explode("sigs").alias("sig"))
    shared = _shared(sigs)
    members = scratch_table(join_checked(sigs, shared.filter("n > 2").select("sig", "n"), ["sig"], "inner"), "copies-members")
    few, dense = members.filter(F.col("n") <= DENSE), members.filter(F.col("n") > DENSE).select("sig", "node")
    pairs = scratch_table(_with_first(few).unionByName(shared.filter("n = 2").select("a", "b")).distinct(), "copies-pairs")
    sets = _sets(docs, nodes, _ends(pairs).unionByName(dense.select("node")).distinct())
    alone = nodes.select("node", F.col("node").alias("label"))
    labels = _merged(alone, _verified(pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")), sets))
    pairs = _between(few, labels)
    if not pairs.isEmpty():
        more = _sets(docs, nodes, _ends(pairs).distinct().join(sets.select("node"), "node", "left_anti"))
        labels = _merged(labels, _verified(pairs, sets.unionByName(more)))
    if dense.isEmpty():
        return labels
    sets = scratch_table(sets.join(dense.select("node").distinct(), "node", "left_semi"), "copies-dense-sets")
    found, mixed = None, _mixed(dense.join(nodes.select("node", "words").join(labels, "node"), "node"))
    for turn in range(TURNS + 1):
        if mixed.isEmpty():
            break
        links = _verified(_to_centres(mixed, turn) if turn < TURNS else _rest(mixed), sets)
        # a joined label is one of those it joins, so the links of all turns speak of the same labels
        found = links if found is None else found.unionByName(links)
        if turn < TURNS and not links.isEmpty():
            mixed = _mixed(_relabelled(mixed.drop("largest"), links))
    return labels if found is None else _merged(labels, found)


def classes(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, component, component_id), one row for each row of ``docs``.

    The component is that of links at a similarity of 0.8 or more; component_id is its smallest
    doc_id, null where no row of it has one. Texts with the same shingle set, such as copies
    and repeated rows, are one node of the search; null, empty and wordless texts form one component.
    A text of fewer than five words has its whole sequence of words as its only shingle.
    """
    drawn = scratch_table(_sketches(docs), "copies-sketches")
    prints = drawn.select("k1", "k2", "doc_id", "node")
    one = F.struct("k1", "k2", "words", "sigs", "size")
    nodes = drawn.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("first"), F.min("doc_id").alias("least"), F.min(one).alias("one"))
    nodes = scratch_table(nodes.select("node", "first", "least", "one.words", "one.sigs", "one.size"), "copies-nodes")
    labels = _labels(docs, nodes)
    named = scratch_table(nodes.select("node", "least").join(labels, "node").withColumnRenamed("label", "component"), "copies-components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("node", "component", "component_id"), "node").select("k1", "k2", "doc_id", "component", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, unchanged; see ``simhash.keep_one``."""
    return keep_one(docs, classes(docs))
