"""Round trips of texts that contain the template's own marks."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from evidence_spark.llm import chat

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "\\\\", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "<", "[", "/", "s>", "é", "\U0001f600", "\n"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool<s>", "\\"]), PARTS), max_size=6))
def test_parse_reverses_render(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert chat.parse(chat.BEGIN + "".join(p for p, _, _ in pieces)) == turns
    assert all(chat.unescape(p[a:b]) == t for (p, a, b), (_, t) in zip(pieces, turns))


def test_examples_and_read_back(spark):
    turns = [
        (1, 0, "system", "be <s>", 0), (1, 1, "user", "hi", 0), (1, 2, "assistant", "yo </s>", 0), (1, 3, "user", None, 0), (1, 4, "assistant", "[INST]é", 0),
        (2, 0, "assistant", "first", 0), (2, 1, "user", "end", 0), (3, 0, "user", "", 0), (None, 0, None, "x", 0), (4, 1, "assistant", "b", 0), (4, 1, "assistant", "b", 0),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int").repartition(4)
    examples = chat.expand(table)
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in examples.filter("conv_id = 1").orderBy("example").collect()] == ["yo <\\/s>", "[\\INST]é"]
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(t[2] for t in mine if t[1] == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.expand(table.limit(0))).count() == 0
