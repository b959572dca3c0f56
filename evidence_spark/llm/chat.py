"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import map_rows

#: Marks of the template, which never occur in an escaped text.
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END = "<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END, TURN_END = "[ROLE]", "[/ROLE]", "[/TURN]"
_CONTROLS = re.compile("|".join(re.escape(x.strip()) for x in (BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END, TURN_END)))
_ESCAPES = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes are doubled, a control string gets one after its first character."""
    return _CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPES.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends in it."""
    inner = escape(text)
    if role == "user":
        before, after = USER, USER_END
    elif role == "assistant":
        before, after = " ", END
    elif role == "system":
        before, after = SYSTEM, SYSTEM_END
    else:
        before, after = ROLE + escape(role) + ROLE_END, TURN_END
    return before + inner + after, len(before), len(before) + len(inner)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    at, turns = len(BEGIN), []
    while at < len(formatted):
        if formatted.startswith(USER, at):
            role, start, mark = "user", at + len(USER), USER_END
        elif formatted.startswith(SYSTEM, at):
            role, start, mark = "system", at + len(SYSTEM), SYSTEM_END
        elif formatted.startswith(ROLE, at):
            stop = formatted.index(ROLE_END, at)
            role, start, mark = unescape(formatted[at + len(ROLE) : stop]), stop + len(ROLE_END), TURN_END
        else:
            role, start, mark = "assistant", at + 1, END
        stop = formatted.index(mark, start)
        turns.append((role, unescape(formatted[start:stop])))
        at = stop + len(mark)
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, whole, formatted, loss_start, loss_end), positions in code points.

    Each assistant turn becomes an example of its own: all turns before it as context, then
    the reply, whose text alone is under the loss mask. What follows the last reply, or a
    conversation without one, ends in an example without a mask, so no turn is lost;
    ``whole`` marks the example that holds the entire conversation. Turns are ordered by turn, then
    role and text; a null role or text is an empty one, rows without a conv_id form one
    conversation. An example holds its whole context, so a row is as long as its conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def rows(c):
        for conv, turns in zip(c["conv_id"], c["turns"]):
            so_far, example = BEGIN, 0
            for i, t in enumerate(turns):
                piece, start, stop = render(t["role"], t["text"])
                if t["role"] == "assistant":
                    yield conv, example, i == len(turns) - 1, so_far + piece, len(so_far) + start, len(so_far) + stop
                    example += 1
                so_far += piece
            if turns[-1]["role"] != "assistant":
                yield conv, example, True, so_far, len(so_far), len(so_far)

    names = ["conv_id", "example", "whole", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    return map_rows(grouped, "conv_id long, example int, whole boolean, formatted string, loss_start long, loss_end long", rows, names, types, 256)


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the
    formatted examples alone."""

    def rows(c):
        for conv, example, whole, formatted, start, stop in zip(*(c[x] for x in ("conv_id", "example", "whole", "formatted", "loss_start", "loss_end"))):
            turns, digest = parse(formatted) if whole else [], hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            yield conv, example, len(turns) if whole else None, digest.hexdigest() if whole else None, unescape(formatted[start:stop]), len(formatted)

    names = ["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    parts = map_rows(examples, "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long", rows, names, types, 256)
    in_order = F.array_sort(F.collect_list(F.struct("example", "loss")))
    grouped = parts.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), in_order.alias("losses"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
