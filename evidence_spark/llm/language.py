"""Language of documents by a linear-chain conditional random field over their words.

Each word of a text, code-switched or not, gets a distribution over the learned languages: a
word's affixes, its n-grams of letters and the lexicons it stands in weigh for each of them,
learned transitions tie neighbouring words together, and forward-backward gives the marginals.
A document is in the language with the largest mean marginal.

Labels say one language for a document; to learn transitions, parts of documents in several
languages are joined to training sequences. The field is fitted in the driver on a bounded
sample; scoring is one pass over the texts without a shuffle. Long texts are cut into segments
of ``SEGMENT`` words whose transfer matrices are multiplied, which gives the same marginals as
one pass from word to word.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed, map_rows
from evidence_spark.session import scratch_table

#: What is learned from: texts and stretches of words of each language, languages, features.
TEXTS, STRETCHES, STRETCH_WORDS, LANGUAGES, FEATURES = 500, 2500, 24, 64, 30_000
LEAST_WORDS, LEXICON_WORDS, TURNS, RATE, PENALTY = 3, 5, 40, 0.15, 2e-5
PARTS = 3  # parts of stretches in a training sequence
SEGMENT, AT_ONCE, CACHE = 64, 300_000, 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LEAST_LOG = -8.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a row without an id counts as one to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def features_of(word: str, lexicons: dict[str, list[str]]) -> list[str]:
    """Names of the features of a word: affixes, 2- and 3-grams with its ends, lexicons."""
    framed = f"^{word}$"
    n = len(framed)
    grams = [framed[i : i + 2] for i in range(n - 1)] + [framed[i : i + 3] for i in range(n - 2)]
    affixes = [f"<{word[:4]}", f">{word[-2:]}", f">{word[-4:]}"] if len(word) > 3 else [f"={word}"]
    return grams + affixes + lexicons.get(word, [])


class Field:
    """Weights: ``emit`` (features x languages), ``move`` (from x to), ``start``; all logarithms."""

    def __init__(self, languages: list[str], features: dict[str, int], lexicons: dict[str, list[str]]):
        k = len(languages)
        self.languages, self.features, self.lexicons = languages, features, lexicons
        self.emit, self.move, self.start = np.zeros((len(features), k)), np.zeros((k, k)), np.zeros(k)

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words and where each word's begin."""
        known = self.features
        each = [[known[f] for f in features_of(w, self.lexicons) if f in known] for w in words]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((f for x in each for f in x), np.int64, int(counts.sum())), np.concatenate([[0], np.cumsum(counts)])

    def emissions(self, numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(words x languages): the summed weights of each word's features."""
        total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.emit[numbers], axis=0)])
        return total[edges[1:]] - total[edges[:-1]]


def _positive(logs: np.ndarray) -> np.ndarray:
    return np.exp(logs - logs.max())


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals, summed expected transitions and log-likelihood constants of padded sequences.

    ``emit`` is (sequences x steps x languages) in logarithms, sequences by descending length.
    """
    n, steps, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    t, s = np.exp(move), np.exp(start)
    alpha, scale = np.zeros_like(e), np.ones((n, steps))
    for i in range(steps):
        m = int(np.searchsorted(-lengths, -i, side="left"))  # those longer than i
        a = e[:m, i] * (s if i == 0 else alpha[:m, i - 1] @ t)
        scale[:m, i] = a.sum(axis=1)
        alpha[:m, i] = a / scale[:m, i, None]
    beta, moved = np.ones((n, k)), np.zeros((k, k))
    gamma = np.zeros_like(e)
    for i in range(steps - 1, -1, -1):
        m = int(np.searchsorted(-lengths, -i, side="left"))
        gamma[:m, i] = alpha[:m, i] * beta[:m]
        if i:
            following = e[:m, i] * beta[:m] / scale[:m, i, None]
            moved += t * (alpha[:m, i - 1].T @ following)
            beta[:m] = following @ t.T
    inside = np.arange(steps) < lengths[:, None]
    return gamma, moved, float((np.log(scale) + top[:, :, 0])[inside].sum())


def _sequences(stretches: list[tuple[int, list[int]]], seed: int) -> list[list[tuple[int, int]]]:
    """Training sequences of (word, language): stretches cut in two at random places, the parts
    shuffled and joined by ``PARTS``."""
    draw = np.random.RandomState(seed)
    parts = []
    for label, words in stretches:
        cut = draw.randint(0, len(words) + 1)
        parts += [[(w, label) for w in part] for part in (words[:cut], words[cut:]) if part]
    order = draw.permutation(len(parts))
    return [[x for i in order[at : at + PARTS] for x in parts[i]] for at in range(0, len(parts), PARTS)]


def objective(field: Field, numbers: np.ndarray, edges: np.ndarray, words: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood per word of padded training sequences and its gradients."""
    k, total = len(field.languages), int(lengths.sum())
    inside = np.arange(words.shape[1]) < lengths[:, None]
    by_word = field.emissions(numbers, edges)
    gamma, moved, constant = forward_backward(by_word[words] * inside[:, :, None], lengths, field.move, field.start)
    seen = np.zeros_like(gamma)
    np.put_along_axis(seen, labels[:, :, None], 1.0, axis=2)
    seen *= inside[:, :, None]
    gap = (seen - gamma)[inside]
    per_word = np.stack([np.bincount(words[inside], gap[:, j], len(edges) - 1) for j in range(k)], axis=1)
    spread = np.repeat(per_word, np.diff(edges), axis=0)
    g_emit = np.stack([np.bincount(numbers, spread[:, j], len(field.emit)) for j in range(k)], axis=1)
    pairs = inside[:, 1:]
    observed = np.bincount(labels[:, :-1][pairs] * k + labels[:, 1:][pairs], minlength=k * k).reshape(k, k)
    first = np.bincount(labels[:, 0], minlength=k)
    told = float((by_word[words] * seen).sum() + (observed * field.move).sum() + first @ field.start)
    return (told - constant) / total, g_emit / total, (observed - moved) / total, (first - gamma[:, 0].sum(axis=0)) / total


def fitted(stretches: list[tuple[str, list[str]]], seed: int = 7, turns: int = TURNS) -> Field | None:
    """A field from (language, words) by gradient steps with moment estimates; None without any."""
    stretches = [(lang, words) for lang, words in stretches if words]
    if not stretches:
        return None
    languages = sorted({lang for lang, _ in stretches})
    number = {lang: i for i, lang in enumerate(languages)}
    counts = Counter((w, lang) for lang, words in stretches for w in words)
    lexicons: dict[str, list[str]] = {}
    for (w, lang), n in sorted(counts.items()):
        if n >= LEXICON_WORDS:
            lexicons.setdefault(w, []).append(f"#{lang}")
    known: dict[str, int] = {}
    plain = [(number[lang], [known.setdefault(w, len(known)) for w in words]) for lang, words in stretches]
    types = list(known)
    usual = Counter(f for w in types for f in set(features_of(w, lexicons)))
    chosen = sorted((f for f, n in usual.items() if n >= LEAST_WORDS), key=lambda f: (-usual[f], f))[:FEATURES]
    field = Field(languages, {f: i for i, f in enumerate(chosen)}, lexicons)
    numbers, edges = field.table(types)
    sequences = sorted(_sequences(plain, seed), key=len, reverse=True)
    lengths = np.array([len(s) for s in sequences])
    words, labels = np.zeros((len(sequences), lengths[0]), np.int64), np.zeros((len(sequences), lengths[0]), np.int64)
    for i, s in enumerate(sequences):
        words[i, : len(s)], labels[i, : len(s)] = zip(*s)
    weights = [field.emit, field.move, field.start]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, turns + 1):
        _, *slopes = objective(field, numbers, edges, words, labels, lengths)
        for w, g, m, v in zip(weights, slopes, first, second):
            g = g - PENALTY * w
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            w += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.95**turn)) + 1e-8)
    return field


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Scorer:
    """Marginals of documents, many at a time; remembers the emissions of words."""

    def __init__(self, field: Field):
        self.field, k = field, len(field.languages)
        self.move, self.start = _positive(np.maximum(field.move - field.move.max(), _LEAST_LOG)), _positive(np.maximum(field.start - field.start.max(), _LEAST_LOG))
        self.known = _Numbers()
        self.emit, self.letter = np.zeros((0, k)), np.zeros(0, bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words; new words get theirs, with their emissions."""
        known, before = self.known, len(self.known)
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > before:
            new = list(islice(reversed(known), len(known) - before))[::-1]
            logs = self.field.emissions(*self.field.table(new))
            floor = np.maximum(logs - logs.max(axis=1, keepdims=True), -30.0)
            self.emit = np.concatenate([self.emit, np.exp(floor)])
            self.letter = np.concatenate([self.letter, np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))])
        return out

    def marginals(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(words x languages) of documents that stand one after the other; none is empty."""
        k = self.emit.shape[1]
        per = -(-lengths // SEGMENT)  # segments of each document
        doc = np.repeat(np.arange(len(lengths)), per)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(lengths) - lengths, per) + index * SEGMENT
        size = np.minimum(SEGMENT, lengths[doc] - index * SEGMENT)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin, size, index = begin[order], size[order], index[order]
        active = [int(np.searchsorted(-size, -i, side="left")) for i in range(SEGMENT)]
        opens = index == 0
        at = lambda i: self.emit[numbers[begin[: active[i]] + i]]
        # how a segment turns what comes in into what goes out
        through = np.where(opens[:, None, None], np.eye(k), self.move) * at(0)[:, None, :]
        for i in range(1, SEGMENT):
            m = active[i]
            if m:
                through[:m] = (through[:m].reshape(-1, k) @ self.move).reshape(m, k, k) * at(i)[:, None, :]
        # from segment to segment, for all documents at once
        entering, leaving = np.empty((len(order), k)), np.ones((len(order), k))
        starts = np.cumsum(per) - per
        now, where = np.tile(self.start, (len(per), 1)), np.arange(len(per))
        for j in range(int(per.max())):
            where = where[per[where] > j]
            s = place[starts[where] + j]
            entering[s] = now[where]
            out = np.einsum("ni,nij->nj", now[where], through[s])
            now[where] = out / out.sum(axis=1, keepdims=True)
        now = np.ones((len(per), k))
        for j in range(int(per.max()) - 1, -1, -1):
            where = np.flatnonzero(per > j)
            s = place[starts[where] + j]
            leaving[s] = now[where]
            back = np.einsum("nij,nj->ni", through[s], now[where])
            now[where] = back / back.sum(axis=1, keepdims=True)
        alpha = np.empty((len(order), SEGMENT, k))
        state = np.where(opens[:, None], entering, entering @ self.move)
        for i in range(SEGMENT):
            m = active[i]
            if m:
                state = (state[:m] if i == 0 else state[:m] @ self.move) * at(i)
                alpha[:m, i] = state
        out, beta = np.empty((len(numbers), k)), leaving
        for i in range(SEGMENT - 1, -1, -1):
            m = active[i]
            if m:
                gamma = alpha[:m, i] * beta[:m]
                out[begin[:m] + i] = gamma / gamma.sum(axis=1, keepdims=True)
                if i:
                    beta[:m] = (at(i) * beta[:m]) @ self.move.T
        return out

    def documents(self, texts: list[str | None]):
        """For each text its words, their numbers and marginals; words are empty without a letter."""
        at, k = 0, len(self.field.languages)
        while at < len(texts):
            if len(self.known) > CACHE:
                self.known, self.emit, self.letter = _Numbers(), self.emit[:0], self.letter[:0]
            held, total = [], 0
            while at < len(texts) and (total < AT_ONCE or not held):
                held.append(words_of(texts[at] or ""))
                total += len(held[-1])
                at += 1
            numbers = self.numbers(list(chain.from_iterable(held)))
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            of = np.repeat(np.arange(len(held)), lengths)
            letters = np.bincount(of[self.letter[numbers]], minlength=len(held)) > 0
            lengths = np.where(letters, lengths, 0)
            whole = self.marginals(numbers[letters[of]], lengths[letters]) if letters.any() else np.zeros((0, k))
            end = np.cumsum(lengths)
            for words, n, e in zip(held, lengths.tolist(), end.tolist()):
                yield words if n else [], whole[e - n : e]


def learned(docs: DataFrame) -> Field | None:
    """A field from a bounded sample of the rows with a language that are not held out: of each of
    the ``LANGUAGES`` most frequent languages ``TEXTS`` whole texts and of their stretches of
    ``STRETCH_WORDS`` words ``STRETCHES``, those with the smallest hashes."""
    lang = F.col("row.lang").cast("string")
    usable = keyed(docs).filter(lang.isNotNull() & F.col("row.text").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    usable = usable.select("k1", "k2", lang.alias("lang"), F.xxhash64(F.lit(5), "k1", "k2").alias("order"), "text")
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    often = scratch_table(often, "language-counts")
    first = Window.partitionBy("lang").orderBy("order", "k1", "k2")
    # twice as many by their hashes as are needed, then exactly as many
    below = F.least(F.lit(1.0), F.lit(2.0 * TEXTS) / F.col("n")) * F.lit(1 << 30)
    narrow = usable.select("k1", "k2", "lang", "order").join(F.broadcast(often), "lang").filter(F.pmod("order", F.lit(1 << 30)) <= below)
    chosen = narrow.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= TEXTS).select("k1", "k2", F.col("lang").alias("of"))
    chosen = scratch_table(chosen.distinct(), "language-chosen")
    texts = join_checked(usable, chosen, ["k1", "k2"], "inner").filter("lang = of").select("lang", "text", "order")

    def rows(c):
        for of, text, order in zip(c["lang"], c["text"], c["order"]):
            words = words_of(text)
            for i in range(0, len(words), STRETCH_WORDS):
                yield of, order, i, words[i : i + STRETCH_WORDS]

    names, types = ["lang", "order", "i", "words"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    cut = map_rows(texts, "lang string, order long, i long, words array<string>", rows, names, types, 5000)
    mixed = Window.partitionBy("lang").orderBy(F.xxhash64("order", "i"), "order", "i", F.array_join("words", " "))
    taken = cut.withColumn("at", F.row_number().over(mixed)).filter(F.col("at") <= STRETCHES)
    return fitted([(r["lang"], list(r["words"])) for r in taken.orderBy("lang", "at").select("lang", "words").collect()])


def _scored(docs: DataFrame, field: Field | None, schema: str, names: list[str], types: list[pa.DataType], told) -> DataFrame:
    plain = keyed(docs).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    cache: list[Scorer] = []

    def rows(c):
        if shared.value is None:
            for key in zip(c["k1"], c["k2"], c["doc_id"]):
                yield *key, *told(None, [], np.zeros((0, 0)))
            return
        if not cache:
            cache.append(Scorer(shared.value))
        for key, (words, marginals) in zip(zip(c["k1"], c["k2"], c["doc_id"]), cache[0].documents(c["text"])):
            yield *key, *told(shared.value, words, marginals)

    return map_rows(plain, f"k1 long, k2 long, doc_id long, {schema}", rows, ["k1", "k2", "doc_id", *names], [pa.int64()] * 3 + types, 5000)


def identify(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, lang_pred, score, held_out), one row for each row of ``docs``.

    ``lang_pred`` is the learned language with the largest mean marginal over the words (ties: the
    first by name), ``score`` that mean. Texts that are null or hold no letter are ``und`` with
    score 0, and so is every text when nothing can be learned. Languages and ids play no part
    in a prediction; copies and repeated rows get equal ones.
    """

    def told(field, words, marginals):
        if not words:
            return UNKNOWN, 0.0
        mean = marginals.mean(axis=0)
        best = int(mean.argmax())
        return field.languages[best], min(1.0, float(mean[best]))

    scored = _scored(docs, learned(docs), "lang_pred string, score double", ["lang_pred", "score"], [pa.string(), pa.float64()], told)
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


def language_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, spans), one row for each row of ``docs``: for code-switched texts the
    stretches of words (lang, first, n_words, score) in one language, by each word's largest
    marginal. No spans for texts without a letter."""

    def told(field, words, marginals):
        if not words:
            return ([],)
        best = marginals.argmax(axis=1)
        edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
        return ([{"lang": field.languages[best[a]], "first": a, "n_words": b - a, "score": float(marginals[a:b, best[a]].mean())} for a, b in zip(edges, edges[1:])],)

    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])
    return _scored(docs, learned(docs), "spans array<struct<lang: string, first: long, n_words: long, score: double>>", ["spans"], [pa.list_(span)], told)
