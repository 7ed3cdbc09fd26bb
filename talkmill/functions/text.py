"""Column expressions over message texts: normal form, tokens, sentences, redaction, snippets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions import fixed_values as fixed

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize(text: Column, compose: bool = False) -> Column:
    """Full-width to ASCII, white space folded, lower case. ``compose`` also composes characters (NFC).

    Spark has no NFC function; the composing form runs Arrow batches through Python and is off by default.
    """
    text = _nfc(text) if compose else text
    return F.lower(F.regexp_replace(F.translate(F.translate(text, FULL_WIDTH, HALF_WIDTH), "　", " "), r"(?U)\s+", " "))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(rf"{CJK}+|[a-z0-9_][a-z0-9_./\-]*"), F.lit(0))


def segment(text: Column, keep_singles: bool = True) -> Column:
    """Ordered tokens: identifiers as they stand; runs of Han characters as overlapping pairs.

    ``keep_singles`` (the index) gives the run's single characters instead, so that phrases of any
    length can be matched by position; without it a run of one character is one token.
    """
    is_cjk = lambda r: r.rlike(f"^{CJK}")
    if keep_singles:
        cut = lambda r: F.when(is_cjk(r), F.split(r, "")).otherwise(F.array(r))
    else:
        pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
        cut = lambda r: F.when(is_cjk(r) & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))
    return F.filter(F.flatten(F.transform(_runs(text), cut)), lambda t: t != "")


def _plain(text: Column) -> Column:
    """Lower case, full-width to ASCII only in texts that hold any: what the index sees."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.when(text.rlike("[\\x{FF01}-\\x{FF5E}]"), F.translate(text, FULL_WIDTH, HALF_WIDTH)).otherwise(text))


TERM = rf"{CJK}|[a-z0-9]+"


def index_terms(text: Column) -> Column:
    """Second stage, for the index: tokens split at what is neither letter nor digit. ``a/b_c.ts`` is a b c ts."""
    return F.regexp_extract_all(_plain(text), F.lit(TERM), F.lit(0))


def unit_pattern(unit: list[str]) -> str:
    """Matches the first of the unit's terms where the others follow it side by side, so that overlapping ones count too."""
    word = lambda t: t.isascii()
    piece = lambda t: rf"(?<![a-z0-9]){t}(?![a-z0-9])" if word(t) else t
    gap = rf"(?:(?!{CJK})[^a-z0-9])*"
    rest = "".join(gap + piece(t) for t in unit[1:])
    return piece(unit[0]) + (f"(?={rest})" if rest else "")


def term_counts(text: Column, units: list[list[str]]) -> Column:
    """struct(_len, _tf0, _tf1, ...): terms of a text, and how often each unit's terms stand side by side."""
    plain = _plain(text)
    counts = [F.regexp_count(plain, F.lit(unit_pattern(u))).alias(f"_tf{i}") for i, u in enumerate(units)]
    return F.struct(F.regexp_count(plain, F.lit(TERM)).alias("_len"), *counts)


def sentences(text: Column) -> Column:
    """Trimmed sentences: soft line breaks are merged, then the text is cut after 。！？!? or a line feed."""
    merged = F.regexp_replace(text, r"([^\n。！？!?])\n(?!\n)", "$1")
    return F.filter(F.transform(F.split(merged, r"(?<=[。！？!?\n])"), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_of(text: Column) -> Column:
    return F.substring(collapse(text), 1, 60)


def redact(text: Column) -> Column:
    for _, pattern, replacement in fixed.REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redaction_counts(text: Column) -> Column:
    """struct of the number of matches of each pattern; each sees the text as the ones before it left it."""
    counts = []
    for name, pattern, replacement in fixed.REDACTIONS:
        counts.append(F.regexp_count(text, F.lit(pattern)).cast("long").alias(name.replace("-", "_")))
        text = F.regexp_replace(text, pattern, replacement)
    return F.struct(*counts)


def excerpt(text: Column, token: Column) -> Column:
    """120 characters from 40 before the token's first occurrence (or from the start), white space collapsed."""
    at = F.instr(text, token)
    start = F.greatest(F.lit(1), F.when(at > 0, at - 40).otherwise(1))
    return collapse(F.substring(text, start, F.lit(120)))


def clip(text: Column, most: int) -> Column:
    """The first ``most`` characters, with a note of the full length if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… ["), F.length(text), F.lit(" chars]"))).otherwise(text)


def literal_snippet(text: Column, needle: str) -> Column:
    """From 60 before to 80 after the first match, ignoring case, with ellipses where text is cut off."""
    at = F.instr(F.lower(text), needle.lower())
    start, end = F.greatest(F.lit(1), at - 60), F.least(F.length(text) + 1, at + len(needle) + 80)
    return F.when(
        at > 0,
        F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise("")),
    )
