"""Base counts against plain Python, verdicts on plain cases."""

import re

from evidence_spark.llm import quality_rules
from llm_cases import DOCS, awkward


def expected(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 2500 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if marked is None else len(marked)


def test_counts_agree_with_plain_python(spark):
    rows = awkward(40) + [(900, "one two three four five six seven eight nine " * 6 + "#*$ <b>\nq\n q\nq", "", 0, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_rules.assess(docs)
    assert got.count() == len(rows)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got.filter("doc_id IS NOT NULL").collect():
        want = expected(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        if want[4] is not None:
            assert r["n_repeat_words"] == want[4]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.assess(docs.limit(0)).count() == 0


def test_repeated_sequences_and_lines_fail():
    prose = " ".join(f"w{i}" for i in range(200))
    good = quality_rules.measures(prose.encode())
    assert quality_rules.verdict(good) == (False, True) and good["dup_5_share"] == 0
    five = " ".join(f"a b c d e w{i}" for i in range(60))  # repeats five words at a time, never eight
    assert quality_rules.verdict(quality_rules.measures(five.encode())) == (False, False)
    lines = "\n".join(["same old line"] * 40 + [f"w{i} v{i} u{i}" for i in range(60)])
    assert quality_rules.verdict(quality_rules.measures(lines.encode()))[1] is False


def test_short_texts_are_judged_by_the_same_shares():
    def kept(text):
        return quality_rules.verdict(quality_rules.measures(text.encode()))

    repeats = " ".join(f"a b c d e w{i}" for i in range(5))  # 30 words, 25 in repeated fives, never eight
    assert quality_rules.measures(repeats.encode())["n_words"] == 30 and kept(repeats) == (False, False)
    assert kept(" ".join(f"w{i}" for i in range(30))) == (False, True)
    once = "a b c d e f g h i j k l m n o p q r s t u v w x y a b c d e"  # one phrase twice: 10 of 30 words
    assert kept(once) == (False, True)
    lines = "\n".join(f"some same line\nw{i}" for i in range(6))  # 24 words: 5 of 12 lines repeat
    assert quality_rules.measures(lines.encode())["n_words"] == 24 and kept(lines) == (False, False)
