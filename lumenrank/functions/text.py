"""Column expressions for text: tokens, answer lists, prompts, index parsing.

All of these are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrank import config as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of Unicode letters and digits; null text gives []."""
    toks = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"({C.TOKEN_PATTERN})"), 1)
    return F.coalesce(toks, F.array().cast("array<string>"))


def truncate_tokens(toks: Column | str, max_tokens: int | None) -> Column:
    """Keep the first ``max_tokens`` tokens for a model with a length limit.

    Only a model-backed scorer with a hard input limit passes a number here; the
    built-in encoders and scorers see the whole text (``None``).
    """
    if max_tokens is None:
        return _col(toks)
    return F.slice(_col(toks), 1, int(max_tokens))


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    ws = C.WS_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def parse_answers(literal: Column | str) -> Column:
    """A Python list literal of strings to ``array<string>``; bad or missing gives [].

    ``\\xNN`` escapes are rewritten to ``\\u00NN`` first, as JSON has no ``\\x``.
    """
    fixed = F.regexp_replace(_col(literal), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    parsed = F.from_json(
        fixed,
        "array<string>",
        {"allowBackslashEscapingAnyCharacter": "true", "allowSingleQuotes": "true"},
    )
    return F.coalesce(parsed, F.array().cast("array<string>"))


def answers_literal(answers: Column | str) -> Column:
    """Inverse of ``parse_answers`` for plain strings: ``['a', 'b']``."""
    quoted = F.transform(
        _col(answers),
        lambda a: F.concat(F.lit("'"), F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")),
                                                 F.lit("'"), F.lit("\\'")), F.lit("'")),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def contains_any(text: Column | str, answers: Column | str) -> Column:
    """C11: 1 if any answer is a substring of text (case-sensitive); null text gives 0."""
    t = _col(text)
    hit = F.exists(_col(answers), lambda a: F.contains(t, a))
    return F.coalesce(hit, F.lit(False)).cast("int")


def extract_indices(text: Column | str, limit: Column | int) -> Column:
    """Ranked 1-based indices named in free text.

    Split on runs of commas or whitespace, strip ``[ ] ( ) .`` from both ends,
    keep all-digit tokens with ``1 <= v <= limit``; first occurrence wins.
    """
    lim = F.lit(limit) if isinstance(limit, int) else limit
    parts = F.split(F.coalesce(_col(text), F.lit("")), r"(?U)[,\s]+")
    stripped = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\[\]().]+|[\[\]().]+$", ""))
    digits = F.filter(stripped, lambda p: p.rlike("^[0-9]+$"))
    values = F.transform(digits, lambda p: p.try_cast("int"))
    in_range = F.filter(values, lambda v: v.isNotNull() & (v >= 1) & (v <= lim))
    return F.array_distinct(in_range)


def hyde_prompt(query: Column | str) -> Column:
    """The fixed HyDE instruction around the question."""
    return F.concat(F.lit(C.HYDE_PROMPT_PREFIX), _col(query), F.lit(C.HYDE_PROMPT_SUFFIX))


def hyde_query(query: Column | str, completion: Column | str) -> Column:
    """The stripped completion if non-empty, else the raw query."""
    stripped = strip_ws(completion)
    return F.coalesce(F.nullif(stripped, F.lit("")), _col(query))


def format_instruction(text: Column | str, instruction: str | None, template: str = "{}{}") -> Column:
    """Optional two-slot instruction template in front of a query."""
    if instruction is None:
        return _col(text)
    head, _, tail = template.partition("{}")
    tail_head, _, tail_tail = tail.partition("{}")
    return F.concat(F.lit(head), F.lit(instruction), F.lit(tail_head), _col(text), F.lit(tail_tail))
