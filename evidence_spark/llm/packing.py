"""Best-two-fit packing of token sequences.

Only lengths matter for the choice, and there are at most as many lengths as a sequence has
tokens. So the plan is made from the counts per length, as sequence patterns with a number
of repetitions; the pieces then take their places by their number among pieces of their
length, which Spark counts per partition first.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evidence_spark.llm.common import keyed, map_rows
from evidence_spark.session import scratch_table

CAPACITY = 2048
#: Fixed value: how the library's ByteLevel pre-tokenizer splits a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_encoder(vocabulary: str):
    """text -> ids as the tokenizers library gives them for a byte-level BPE file whose
    pattern is the library's own; its added tokens are found in texts, as there."""
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    # the library's printable stand-ins for bytes: the printable ones stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict(zip([*map(chr, own), *(chr(256 + i) for i in range(256 - len(own)))], [*own, *(b for b in range(256) if b not in own)]))
    if sorted(names) != sorted(pre_tokenizers.ByteLevel.alphabet()):
        raise ValueError("the byte alphabet is not the library's")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(k1, k2, doc_id, piece, start, length, ids_crc32): each document's ids and an end id.

    Only documents longer than ``capacity`` are cut, into full pieces; the first one takes
    the remainder. A null or empty text is the end id alone.
    """
    kept: dict = {}

    def rows(c):
        if "encode" not in kept:
            kept["encode"] = byte_level_encoder(vocabulary)
        for k1, k2, doc, text in zip(c["k1"], c["k2"], c["doc_id"], c["text"]):
            ids = np.array([*kept["encode"](text), end], dtype="<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                yield k1, k2, doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())

    names = ["k1", "k2", "doc_id", "piece", "start", "length", "ids_crc32"]
    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(plain, "k1 long, k2 long, doc_id long, piece int, start long, length long, ids_crc32 long", rows, names, [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3)


def _largest(free: np.ndarray, room: int) -> int:
    """The largest length up to ``room`` that is left, or 0."""
    at = np.flatnonzero(free[1 : room + 1])
    return int(at[-1]) + 1 if room > 0 and len(at) else 0


def _best_two(free: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths that are left with the largest sum up to ``room``, the larger one first."""
    at = np.flatnonzero(free[1 : room + 1]) + 1
    if not len(at):
        return 0, 0
    partner = at[np.maximum(np.searchsorted(at, room - at, "right") - 1, 0)]
    fits = (at + partner <= room) & ((partner != at) | (free[at] > 1))
    if not fits.all():  # a length left once cannot meet itself: its partner is the next smaller one
        lower = at[np.maximum(np.searchsorted(at, np.minimum(room - at, at - 1), "right") - 1, 0)]
        partner = np.where(fits, partner, lower)
        fits = (at + partner <= room) & ((partner != at) | (free[at] > 1))
    if not fits.any():
        return 0, 0
    best = np.argmax(np.where(fits, at + partner, -1))
    return max(int(at[best]), int(partner[best])), min(int(at[best]), int(partner[best]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Sequence patterns (lengths, repetitions) that use up ``counts``.

    Fill: the longest piece left, then always the longest one that still fits. Then, while
    it fills the sequence more tightly, its smallest piece gives way to two that are left.
    A pattern repeats as often as its lengths last, so a step uses up a length or halves it
    at least, and the number of steps does not depend on the number of pieces.
    """
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out = []
    while free.any():
        chosen: list[int] = []
        gap = capacity
        while length := _largest(free, gap):
            chosen.append(length)
            free[length] -= 1
            gap -= length
        while gap and len(chosen) > 1:
            smallest = chosen[-1]
            a, b = _best_two(free, gap + smallest)
            if a + b <= smallest:
                break
            free[smallest] += 1
            free[a] -= 1
            free[b] -= 1
            chosen = sorted([*chosen[:-1], a, b], reverse=True)
            gap = capacity - sum(chosen)
        uses = Counter(chosen)
        times = 1 + min(int(free[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            free[length] -= (times - 1) * n
        out.append((chosen, times))
    return out


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple]:
    """Per length, in the order of its pieces: first number of a run, sequence of the first,
    pieces of this length in one sequence, and their offsets in it (one run a pattern)."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for length, n in Counter(lengths).items():
            runs.setdefault(length, []).append((used[length], sequence, n, at[np.array(lengths) == length]))
            used[length] += n * times
        sequence += times
    return {length: (*(np.array(c) for c in list(zip(*own))[:3]), [r[3] for r in own]) for length, own in runs.items()}


def pack(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table with a column ``length`` (1..capacity).

    The counts per length, ``capacity`` numbers at most, are all that reaches the driver.
    Pieces of equal length are interchangeable and are numbered per input partition, so one
    length may be that of all pieces. Sequences are gapless from offset 0.
    """
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = _places(plan(counts, capacity))
    numbered = scratch_table(stored.withColumn("_id", F.monotonically_increasing_id()), "packing-pieces").withColumn("_part", F.shiftright("_id", 33))
    per_part = numbered.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("length", "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_id")) - 1
    shape = stored.columns
    ranked = numbered.withColumn("_inside", inside).join(starts, ["_part", "length"]).select(*shape, (F.col("_before") + F.col("_inside")).alias("_number"))
    at = shape.index("length")

    def place(batches):
        for batch in batches:
            length, number = batch.column(at).to_numpy(), batch.column(len(shape)).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                first, start, each, offsets = runs[int(value)]
                mine = np.flatnonzero(length == value)
                run = np.searchsorted(first, number[mine], "right") - 1
                within = number[mine] - first[run]
                sequence[mine] = start[run] + within // each[run]
                for r in np.unique(run):
                    offset[mine[run == r]] = offsets[r][within[run == r] % each[r]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(shape)], pa.array(sequence), pa.array(offset)], names=[*shape, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
