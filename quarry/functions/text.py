"""Tokenizer and query-parsing Column expressions (all Catalyst, no UDF).

Tokens are maximal runs of Unicode letters, numbers and private-use
characters, case folded, with diacritics removed (canonical decomposition:
``Crème`` -> ``creme``; ``ß`` and the ``ﬁ`` ligature stay as they are).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}\p{Co}]+"
QUERY_SPLIT = r"\W"  # ASCII word class, as in the query escaper


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str]:
    """(accented, base) strings for ``translate``, built by rule from Unicode.

    A precomposed character maps to the first character of its canonical
    decomposition when the rest of that decomposition is combining marks.
    """
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and all(unicodedata.category(c).startswith("M") for c in d[1:]):
            base = d[0]
            if unicodedata.category(base).startswith("M"):
                continue
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Remove diacritics and fold case."""
    acc, base = accent_tables()
    plain = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), acc, base)
    return F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text))  # ASCII has neither marks nor accents


def tokens(text: Column) -> Column:
    """array<string> of index tokens of ``text`` (empty array for NULL)."""
    parts = F.split(fold(F.coalesce(text, F.lit(""))), TOKEN_SPLIT)
    return F.array_remove(parts, "")


def query_words(q: Column) -> Column:
    """Words of a query: split on the ASCII non-word class, empties dropped."""
    return F.filter(F.split(q, QUERY_SPLIT), lambda w: w != "")


def match_expression(q: Column) -> Column:
    """The full-text match string: every word quoted, last one a prefix."""
    words = query_words(q)
    return F.concat(F.lit('"'), F.array_join(words, '" "'), F.lit('"*'))


def python_tokens(text: str) -> list[str]:
    """Driver/test-side twin of :func:`tokens` for small fixtures."""
    import regex

    acc, base = accent_tables()
    table = {ord(a): b for a, b in zip(acc, base)}
    s = regex.sub(r"\p{Mn}", "", text or "").translate(table).lower()
    return [t for t in regex.split(r"[^\p{L}\p{N}\p{Co}]+", s) if t]
