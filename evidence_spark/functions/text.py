"""Text functions: cleaning, redaction and question classification."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidence_spark import policy
from evidence_spark.functions.scalars import contains_any, text_of

EDGE_SPACE = r"^\s+|\s+$"


def clean_ws(column: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(column), r"\s+", " "))


def ascii_only(column: Column) -> Column:
    """Printable ASCII, at most one blank line in a row, no space at the ends."""
    kept = F.regexp_replace(text_of(column), r"[^\x09\x0A\x0D\x20-\x7E]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), EDGE_SPACE, "")


def plain_dashes(column: Column) -> Column:
    broken = "â€”"
    return F.replace(F.replace(text_of(column), F.lit(broken), F.lit("-")), F.lit("—"), F.lit("-"))


def redact_text(column: Column, pattern: str = policy.SENSITIVE_VALUE_PATTERN) -> Column:
    """The whole value is masked when it holds a long run of hex digits."""
    return F.when(column.rlike(pattern), F.lit("[redacted]")).otherwise(column)


def redact_map(column: Column, key_pattern: str = policy.SENSITIVE_KEY_PATTERN) -> Column:
    kept = F.map_filter(column, lambda key, _: ~key.rlike(key_pattern))
    return F.transform_values(kept, lambda _, value: redact_text(value))


@F.pandas_udf(StringType())
def _redact_json(texts: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    """Nested JSON has no fixed shape that column expressions could walk through."""

    def walk(value, key, hidden):
        if isinstance(value, list):
            return [walk(v, key, hidden) for v in value]
        if isinstance(value, dict):
            return {k: walk(v, key, hidden) for k, v in value.items() if not key.search(k)}
        return "[redacted]" if isinstance(value, str) and hidden.search(value) else value

    def one(text, key, hidden):
        try:
            return json.dumps(walk(json.loads(text), re.compile(key), re.compile(hidden)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(*row) for row in zip(texts, keys, values)], dtype=object)


def redact_json(column: Column, key_pattern: str = policy.SENSITIVE_KEY_PATTERN, value_pattern: str = policy.SENSITIVE_VALUE_PATTERN) -> Column:
    """JSON text without sensitive keys and with long hex runs masked, at any depth of
    objects and lists; null for text that is no JSON."""
    return _redact_json(column, F.lit(key_pattern), F.lit(value_pattern))


def extract_sequences(column: Column, limit: int | None = None) -> Column:
    """Numbers tagged ``seq``, ``sequence`` or ``#``; without any, bare numbers of two
    to six digits. Distinct, in order of appearance."""
    text = text_of(column)
    tagged = F.regexp_extract_all(text, F.lit(r"(?i)(?:seq(?:uence)?\s*#?\s*|#)(\d+)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"\b(\d{2,6})\b"), F.lit(1))
    found = F.when(F.size(tagged) > 0, tagged).otherwise(bare)
    numbers = F.filter(F.transform(found, lambda t: t.try_cast("decimal(38,0)")), lambda v: v.isNotNull())
    distinct = F.array_distinct(numbers)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def question_keywords(column: Column, synonyms: dict[str, list[str]] = policy.QUESTION_SYNONYMS) -> Column:
    text = text_of(column)
    lower = F.lower(text)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_-]{2,})"), F.lit(1)), lambda t: F.lower(t))
    words = F.array_distinct(tokens)
    for key, values in synonyms.items():
        extra = F.array(*(F.lit(v) for v in [key, *values]))
        words = F.when(contains_any(lower, [key, *values]), F.array_union(words, extra)).otherwise(words)
    return words


def is_small_talk(column: Column) -> Column:
    text = F.regexp_replace(F.lower(clean_ws(column)), r"^[ .!?]+|[ .!?]+$", "")
    phrases = policy.SMALL_TALK
    known = text.isin([*phrases, *(f"bb {p}" for p in phrases), *(f"{p} bb" for p in phrases)])
    tokens = F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")
    words = (
        (F.size(tokens) > 0)
        & F.exists(tokens, lambda t: t.isin(policy.GREETINGS))
        & F.forall(tokens, lambda t: t.isin(phrases))
    )
    return known | words


def route_question(column: Column, guidance_terms: list[str] = policy.GUIDANCE_TERMS) -> Column:
    """Kind of answer a question asks for, before any evidence is looked up."""
    lower = F.lower(clean_ws(column))
    return (
        F.when(lower == "", "empty")
        .when(F.size(extract_sequences(column)) > 0, "sequence")
        .when(contains_any(lower, policy.ATTACK_TERMS), "attack_path")
        .when(is_small_talk(column), "small_talk")
        .when(contains_any(lower, guidance_terms), "guidance")
        .otherwise("other")
    )


def json_field(column: Column, path: str) -> Column:
    """Field of JSON text; null for text that is not an object."""
    return F.when(F.trim(column).startswith("{"), F.get_json_object(column, path))
