"""Periodic runs of words: a passage repeated at least four times in a row.

A run is a stretch of words with smallest period q and at least ``max(6, 4 q)`` words that
cannot be made longer. Periods up to ``SHORT`` are found by comparing the text with itself
at that lag. Longer ones are found scale by scale: at scale L = 2 SHORT, 4 SHORT, ... stand
the periods in (L/2, L]. Every L words in a row have a hash, doubled from scale to scale, and
the leftmost least hash of each L/2 neighbouring ones is a minimizer. In a run the minima
come back at the distance of its period, and two equal sequences of L >= q words in a run lie
no less than q apart; so a run shows as a pair of neighbouring equal minimizers at distance
q, and no other pairs need be formed. Such a pair is a seed, extended word by word to both
sides. Without a repeated minimizer at one scale there is no run at any larger one.

One document is one row: time and memory grow with its length (times its logarithm).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import keyed, map_rows

SHORT, LEAST_WORDS, LEAST_TURNS = 8, 6, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WHITE = "[\\x20\\x09-\\x0D]+"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _least(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TURNS * period)


def _by_lag(x: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches with words q apart equal, long enough."""
    differ = np.flatnonzero(x[:-q] != x[q:])
    edges = np.concatenate([[-1], differ, [len(x) - q]])
    equal = np.diff(edges) - 1
    return [(int(edges[i]) + 1, int(equal[i]) + q) for i in np.flatnonzero(equal >= _least(q) - q)]


def _minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least of each ``window`` neighbouring hashes, each once."""
    at, low = np.arange(len(h)), h
    step = 1
    while step < window:  # windows are powers of two
        left, right = low[:-step], low[step:]
        nearer = left <= right
        at, low = np.where(nearer, at[:-step], at[step:]), np.where(nearer, left, right)
        step *= 2
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _seeds(h: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Neighbouring equal minimizers (position, distance) with a distance of this scale, and
    whether any minimizers are equal at all."""
    if len(h) < scale // 2:
        return np.zeros(0, int), np.zeros(0, int), False
    at = _minimizers(h, scale // 2)
    order = np.argsort(h[at], kind="stable")
    at, value = at[order], h[at][order]
    same = value[1:] == value[:-1]
    first, apart = at[:-1][same], np.diff(at)[same]
    fits = (apart > scale // 2) & (apart <= scale)
    order = np.argsort(first[fits], kind="stable")
    return first[fits][order], apart[fits][order], bool(same.any())


def _extent(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """[start, stop) of the longest stretch around ``at`` with words q apart equal."""
    start, stop, step = at, at, 64
    while stop < len(x) - q:
        differ = np.flatnonzero(x[stop : stop + step][: len(x) - q - stop] != x[stop + q : stop + q + step])
        if len(differ):
            stop += int(differ[0])
            break
        stop, step = min(stop + step, len(x) - q), step * 2
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(x[low:start] != x[low + q : start + q])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 2
    return start, stop + q


def _primitive(x: np.ndarray, start: int, q: int) -> bool:
    """Whether no proper divisor of q is a period of the stretch that begins at ``start``."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = q // r
            if np.array_equal(x[start : start + q], x[start + p : start + p + q]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start and period."""
    n, found = len(x), {}
    for q in range(1, min(SHORT, n // LEAST_TURNS) + 1):
        for start, length in _by_lag(x, q):
            found.setdefault((start, length), q)  # a multiple of a smaller period covers the same words
    scale, hashed, h = 1, x, None
    while scale <= n and (scale < 2 * SHORT or scale // 2 < n // LEAST_TURNS):
        h = _mixed(hashed.astype(np.uint64) + _A) if h is None else _mixed(h[: -scale // 2] * _B + h[scale // 2 :])
        if scale >= 2 * SHORT:
            first, apart, repeated = _seeds(h, scale)
            if not repeated:
                break
            reached: dict[int, int] = {}
            for at, q in zip(first.tolist(), apart.tolist()):
                if at < reached.get(q, -1):
                    continue
                start, stop = _extent(x, at, q)
                reached[q] = max(stop - q, at + 1)
                if stop - start >= _least(q) and (start, stop - start) not in found and _primitive(x, start, q):
                    found[start, stop - start] = q
        scale *= 2
    return sorted((start, length, q) for (start, length), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats (of each run its first period stays), joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n_words, runs, collapsed), one row for each row of ``docs``.

    ``runs`` lists (start, length, period) in words by start, then period; ``collapsed`` is the
    text with each run cut down to its first period and words joined by one space. Words are
    what white space of ASCII separates. Null, empty and short texts have no runs; repeated
    rows are each judged alone; other columns play no part.
    """

    def rows(c):
        for k1, k2, doc, body in zip(c["k1"], c["k2"], c["doc_id"], c["body"]):
            words = body.split()
            runs = runs_of(numbered(words)) if len(words) >= LEAST_WORDS else []
            yield k1, k2, doc, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs).decode()

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["k1", "k2", "doc_id", "n_words", "runs", "collapsed"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(run), pa.string()]
    schema = "k1 long, k2 long, doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body")
    return map_rows(plain, schema, rows, names, types, 256)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the same rows and columns, a tenth of the texts ending in a periodic passage.

    h = crc32(decimal doc_id), g = floor(h / 10). Where h % 10 = 0 and the text has n > 0
    words, each word i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)); its words are then joined by spaces. A row
    without a doc_id stays as it is.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    h = F.crc32(F.col("row.doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("row.text", WHITE, -1), lambda w: w != "")
    # a lone array in between, so that the text is split once
    cut = docs.select(row).select("row", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    a = (F.col("g") % n).alias("a")
    p = F.lit(1) + F.floor((n - a) / (3 + F.col("g") % 8))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    text = F.when(F.size("words") > 0, F.array_join(moved, " ")).otherwise(F.col("row.text"))
    return cut.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what
    ``periodic_runs`` returns; the four describe the run with the most turns (ties: the first, then the
    shortest period) and are null without one."""

    def better(best: Column, run: Column) -> Column:
        # runs come by start and period, so of equals the earlier stays
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("*", F.aggregate("runs", none, better).alias("best"), told.alias("told"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
