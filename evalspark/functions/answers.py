"""Answer derivation from choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import col_

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Labels of up to this many letters: 26 + 26^2 + ... options, over 300 million.
LABEL_LETTERS = 6


def edit_distances(answer: str | Column, choices: str | Column) -> Column:
    """Levenshtein distance (code points) from the answer to each choice."""
    a = col_(answer)
    return F.transform(col_(choices), lambda c: F.levenshtein(a, c))


def argmin_first(values: str | Column) -> Column:
    """1-based position of the minimum, first one on ties; null if empty."""
    v = col_(values)
    return F.when(F.size(v) > 0, F.array_position(v, F.array_min(v)).cast("int"))


def option_letter(position: str | Column) -> Column:
    """1-based position -> A..Z, AA, AB, ...; null for no position."""
    p = col_(position).cast("long")
    expr, before = None, 0
    for n in range(1, LABEL_LETTERS + 1):
        rest = p - F.lit(1 + before)
        digits = [F.substring(F.lit(LETTERS), ((F.floor(rest / F.lit(26 ** (n - 1 - k))) % 26) + 1).cast("int"), F.lit(1))
                  for k in range(n)]
        before += 26 ** n
        fits = (p >= 1) & (p <= before)
        label = F.concat(*digits)
        expr = F.when(fits, label) if expr is None else expr.when(fits, label)
    return expr


def nearest_option(answer: str | Column, choices: str | Column) -> Column:
    """Letter of the choice with the smallest edit distance to the answer."""
    return option_letter(argmin_first(edit_distances(answer, choices)))


def option_block(choices: str | Column) -> Column:
    """``A. x\\nB. y\\n`` (trailing newline kept)."""
    lines = F.transform(col_(choices), lambda c, i: F.concat(
        option_letter(i + 1), F.lit(". "), c, F.lit("\n")))
    return F.array_join(lines, "")


def first_element(arr: str | Column) -> Column:
    """First list element (null for an empty list)."""
    return F.try_element_at(col_(arr), F.lit(1))
