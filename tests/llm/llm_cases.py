"""Rows that every operator over documents must get through."""

import random

#: Extra columns carry names that operators use inside.
DOCS = "doc_id long, text string, k1 string, k2 int, body string, batch int"


def awkward(n: int = 60, seed: int = 3) -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows and rows without an id."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8)))
    prose = lambda k: " ".join(word() + r.choice(["", "", ".", ",", "\n"]) for _ in range(k))
    base = prose(300)
    texts = [None, "", " \n\t ", "a", "A a\nA a", base, base, base.upper(), prose(4000), "x" * 5000, "\n" * 50, "a\x1cb\x85c d  e", "<|endoftext|> [INST] \\ </s>"]
    for _ in range(n):
        t = base.split(" ")
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = word()
        texts.append(r.choice([" ".join(t), prose(r.randint(1, 80)), "Shared line\n" + prose(10), prose(5) + "\n  shared LINE \n\nother"]))
    rows = [(i, t, "x", i, None, 0) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], rows[0], (None, base, "y", 1, "z", 1), (None, None, None, None, None, None)]
