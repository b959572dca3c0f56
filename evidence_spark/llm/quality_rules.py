"""Quality rules: how much of a text lies in repeated word sequences and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import keyed, map_rows

BASE_WINDOW = 8
#: Largest allowed share of a text's word characters in repeated sequences of so many words.
SEQUENCE_LIMITS = {5: 0.30, 6: 0.28, 8: 0.26, 10: 0.24}
#: Largest allowed shares of lines, and of their characters, that repeat an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.30
#: Repeated lines from which their share counts: one of three lines is no pattern.
LEAST_LINES = 3
#: A text of fewer words may repeat as many characters as one of so many words of the same
#: length: its limits are multiplied by LEAST_WORDS / n_words, at most twice from 20 words on.
LEAST_WORDS = 40
_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
_FACTOR = np.uint64(0xD6E8FEB86659FD93)



def _repeated_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words found twice or more, by rolling hashes."""
    marked = np.zeros(len(hashes), bool)
    windows = len(hashes) - n + 1
    if windows < 2:
        return marked
    rolled = np.zeros(windows, np.uint64)
    for i in range(n):
        rolled = rolled * _FACTOR + hashes[i : i + windows]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(rolled, twice))
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        marked = np.cumsum(edge[:-1]) > 0
    return marked


def measures(body: bytes) -> dict:
    """The base counts, and the shares that the limits are held against, of one text."""
    words = body.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    points = len(body) - int(((np.frombuffer(body, np.uint8) & 0xC0) == 0x80).sum())
    chars = points - sum(body.count(c) for c in _WHITE)
    sizes = np.fromiter(map(len, words), np.int64, n)
    total = max(1, int(sizes.sum()))
    marked = {k: _repeated_words(hashes, k) for k in {*SEQUENCE_LIMITS, BASE_WINDOW}}
    lines = [x for x in body.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    repeated = [x for x in lines if x in seen or seen.add(x)]
    out = {
        "n_words": n, "word_chars": chars, "n_symbols": sum(body.count(c) for c in _SYMBOLS), "n_dup_lines": len(repeated),
        "n_repeat_words": int(marked[BASE_WINDOW].sum()), "dup_line_share": len(repeated) / max(1, len(lines)),
        "dup_line_char_share": sum(map(len, repeated)) / max(1, sum(map(len, lines))),
    }
    return out | {f"dup_{k}_share": float(sizes[m].sum()) / total for k, m in marked.items()}


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept). Every text that passes the base rule is held against the same
    shares; below LEAST_WORDS words their limits grow as the text gets shorter."""
    failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    if failed:
        return True, False
    ease = max(1.0, LEAST_WORDS / m["n_words"])
    within = all(m[f"dup_{k}_share"] <= limit * ease for k, limit in SEQUENCE_LIMITS.items())
    few = m["n_dup_lines"] < LEAST_LINES or m["dup_line_share"] <= LINE_LIMIT * ease
    return False, within and few and m["dup_line_char_share"] <= LINE_CHARS_LIMIT * ease


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHARES = ["dup_line_share", "dup_line_char_share", *(f"dup_{k}_share" for k in sorted({*SEQUENCE_LIMITS, BASE_WINDOW}))]


def assess(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, the base counts, base_failed, kept, the shares), one row for each row.

    A null or empty text has no words, fails and has shares of zero. Words are separated by
    ASCII white space; rows that are repeated whole are assessed each.
    """

    def rows(c):
        for k1, k2, doc, body in zip(c["k1"], c["k2"], c["doc_id"], c["body"]):
            m = measures(body)
            yield k1, k2, doc, *(m[x] for x in _COUNTS), *verdict(m), *(m[x] for x in _SHARES)

    names = ["k1", "k2", "doc_id", *_COUNTS, "base_failed", "kept", *_SHARES]
    types = [pa.int64()] * 8 + [pa.bool_()] * 2 + [pa.float64()] * len(_SHARES)
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'double'}" for n, t in zip(names, types))
    return map_rows(keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "body"), schema, rows, names, types)
