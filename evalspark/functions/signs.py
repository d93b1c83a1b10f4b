"""Correctness signs: verdict vs answer -> 0/1 int.

All rules are built-in expressions, so they stay inside whole-stage
codegen. Only the general Python-literal comparison of S4 needs Python;
it runs on the rows the JVM fast path cannot decide (see ``literals``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import PY_WHITESPACE, col_, decimal_digit_runs, py_strip, verdict_tokens

# The grammars Python's int() and float() accept, on texts whose
# decimal digits (any of Unicode's) are written in ASCII; single underscores may
# stand between digits. Every repetition is possessive: the regex engine then
# reads a run of any length in a loop, where a greedy group costs it a stack frame each time.
_WS = PY_WHITESPACE
_DIGITS = "[0-9]++(?:_[0-9]++)*+"
INT_PATTERN = f"^{_WS}*+[+-]?+{_DIGITS}{_WS}*+$"
FLOAT_PATTERN = (f"^{_WS}*+[+-]?+(?:(?:{_DIGITS}(?:\\.(?:{_DIGITS})?+)?+|\\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+"
                 f"|(?i:infinity|inf|nan)){_WS}*+$")
_OTHER_DIGITS = "".join(chr(zero + i) for zero in decimal_digit_runs()[1:] for i in range(10))
_ASCII_DIGITS = "0123456789" * (len(_OTHER_DIGITS) // 10)
# A whole list of plain numbers, which JSON and Python read alike: no leading
# zeros, no infinities, and at most 15 digits before the point, so that a
# double holds every integer exactly. Anything else is left to Python.
_NUMBER = "-?(?:0|[1-9][0-9]{0,14})(?:\\.[0-9]{1,15})?(?:[eE][+-]?[0-9]{1,2})?"
NUMBER_LIST_PATTERN = f"^[ \\t]*\\[ *+(?:{_NUMBER}(?: *+, *+{_NUMBER})*+)?+ *+\\] *+$"
# Only such a text can be a Python list.
LIST_START = f"^{_WS}*[\\[\\(]"
# Longer texts go to Python: long repetitions overflow the regex engine's stack.
FAST_CHARS = 4000
# A Python literal starts with one of these (anything else is a name or junk).
LITERAL_START = f"^{_WS}*(?:[\\[\\(\\{{'\"0-9+.-]|True|False|None)"


def _ascii_digits(c: Column) -> Column:
    """The text with every decimal digit in ASCII. ASCII text, nearly always, has as
    many bytes as characters and stays as it is."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _OTHER_DIGITS, _ASCII_DIGITS))


def _plain(c: Column) -> Column:
    """A number's text without white space around it and underscores."""
    return F.replace(py_strip(c), F.lit("_"), F.lit(""))


def _as_int(c: Column) -> Column:
    """An integer's canonical text, of any length: sign if negative, digits without leading zeros."""
    plain = _plain(c)
    size = F.ltrim(F.ltrim(plain, F.lit("+-")), F.lit("0"))
    return F.when(size == "", F.lit("0")).otherwise(F.concat(F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit("")), size))


def _as_double(c: Column) -> Column:
    return _plain(c).try_cast("double")


def _as_number_list(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def _is_number_list(text: Column) -> Column:
    return F.coalesce((F.length(text) <= FAST_CHARS) & text.rlike(NUMBER_LIST_PATTERN), F.lit(False))


def token_sign(verdict: str | Column, answer: str | Column) -> Column:
    """1 if lower(answer) is a whole token of the normalised verdict."""
    hit = F.array_contains(verdict_tokens(verdict), F.lower(col_(answer)))
    return F.coalesce(hit, F.lit(False)).cast("int")


def contains_sign(verdict: str | Column, answer: str | Column) -> Column:
    """S3: 1 if answer (as given) is a substring of lower(verdict)."""
    hit = F.contains(F.lower(col_(verdict)), col_(answer))
    return F.coalesce(hit, F.lit(False)).cast("int")


def exact_sign(verdict: str | Column, word: str = "correct") -> Column:
    """Verdict equals the word exactly (case-sensitive)."""
    return F.coalesce(col_(verdict) == F.lit(word), F.lit(False)).cast("int")


def answer_kind(answer: str | Column) -> Column:
    """Type of a numeric answer: int, float, list (number list), literal, text."""
    a = col_(answer)
    return (F.when(_ascii_digits(a).rlike(INT_PATTERN), F.lit("int"))
            .when(_ascii_digits(a).rlike(FLOAT_PATTERN), F.lit("float"))
            .when(_is_number_list(a), F.lit("list"))
            .when(a.rlike(LITERAL_START), F.lit("literal"))
            .otherwise(F.lit("text")))


def numeric_sign(verdict: str | Column, answer: str | Column) -> Column:
    """S4 fast path; null only where Python must decide.

    The answer's type picks the rule, tested in order (each test runs at
    most once per row): int grammar -> the verdict must match the integer
    grammar and be equal; float grammar -> the verdict must parse as a
    float and be equal (NaN never equals NaN); whole number list -> element-wise
    equality in order; other literal-looking text -> null; text -> 0.
    """
    raw_v, raw_a = col_(verdict), col_(answer)      # a literal has ASCII digits only
    v, a = _ascii_digits(raw_v), _ascii_digits(raw_a)
    vi, ai = _as_int(v), _as_int(a)
    int_sign = F.when(~F.coalesce(v.rlike(INT_PATTERN), F.lit(False)), F.lit(0)).otherwise((vi == ai).cast("int"))
    vd, ad = _as_double(v), _as_double(a)
    float_eq = v.rlike(FLOAT_PATTERN) & (vd == ad) & ~F.isnan(ad)
    vl, al = _as_number_list(raw_v), _as_number_list(raw_a)
    list_sign = (F.when(_is_number_list(raw_v), (vl == al).cast("int"))
                 .when(raw_v.rlike(LIST_START), F.lit(None))    # other literal: Python decides
                 .otherwise(F.lit(0)))
    return (F.when(raw_a.isNull() | raw_v.isNull(), F.lit(0))
            .when(a.rlike(INT_PATTERN), int_sign)
            .when(a.rlike(FLOAT_PATTERN), F.coalesce(float_eq, F.lit(False)).cast("int"))
            .when(_is_number_list(raw_a), list_sign)
            .when(raw_a.rlike(LITERAL_START), F.lit(None).cast("int"))
            .otherwise(F.lit(0)))
