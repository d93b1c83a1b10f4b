"""Verdict and answer normalisation as Catalyst expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a verdict loses before tokenising, and the
# whitespace set of Python's str.isspace()/strip()/re \s, written as one
# regex class that both Java regex and RE2 accept.
VERDICT_STRIP_CHARS = ".()[],:;!*#{}"
PY_WHITESPACE = ("[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
                 "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# The same whitespace set as literal characters, for char-set trimming.
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")

# Ternary label words and their codes.
TERNARY_LABELS = {"yes": 1, "no": 0, "unclear": -1}


def decimal_digit_runs() -> list[int]:
    """Code points of the zeros of Unicode's decimal digits, each followed by its
    one to nine, in ascending order (the first is ASCII's)."""
    return [c for c in range(sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) == 0
            and unicodedata.category(chr(c)) == "Nd"]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row (bound as a lambda variable).

    Catalyst does not share a heavy sub-expression that appears several
    times inside one expression (e.g. a parse used in a size check and in
    the result); binding it through a one-element ``transform`` does.
    """
    return F.try_element_at(F.transform(F.array(value), fn), F.lit(1))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once per row, whatever reads them.

    Catalyst writes a column's expression out at every place that uses it if nothing
    stands between; a one-row generator does.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace.

    A character-set trim touches only the ends of the text, unlike a
    ``\\s+$`` regex that is retried at every position of a long text.
    """
    return F.trim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def verdict_tokens(verdict: str | Column) -> Column:
    """Lower, punctuation to spaces, collapse whitespace, trim, split on ' '."""
    v = F.translate(F.lower(col_(verdict)), VERDICT_STRIP_CHARS, " " * len(VERDICT_STRIP_CHARS))
    v = F.trim(F.regexp_replace(v, f"{PY_WHITESPACE}+", " "))
    return F.split(v, " ")


def yes_no_answer(gt: str | Column) -> Column:
    """1 -> 'yes', anything else (null included) -> 'no'."""
    return F.when(col_(gt) == 1, F.lit("yes")).otherwise(F.lit("no"))


def lower_strip(c: str | Column) -> Column:
    """``x.lower().strip()``."""
    return py_strip(F.lower(col_(c)))


def paren_letter(c: str | Column) -> Column:
    """Letter answer ``A`` -> ``(a)``."""
    return F.concat(F.lit("("), F.lower(col_(c)), F.lit(")"))


def says_yes(c: str | Column) -> Column:
    """1 when 'yes' occurs anywhere in the lowered text (``eyes`` counts)."""
    return F.coalesce(F.contains(F.lower(col_(c)), F.lit("yes")), F.lit(False)).cast("int")


def ternary_label(c: str | Column, strip_dots: bool = False) -> Column:
    """yes/no/unclear -> 1/0/-1 after lowering; optional '.' trim; unknown -> null."""
    x = F.lower(col_(c))
    if strip_dots:
        x = F.regexp_replace(x, r"^\.+|\.+$", "")
    expr = None
    for word, code in TERNARY_LABELS.items():
        expr = F.when(x == word, F.lit(code)) if expr is None else expr.when(x == word, F.lit(code))
    return expr
