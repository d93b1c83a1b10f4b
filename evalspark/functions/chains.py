"""Reasoning-chain text -> typed step arrays.

Default instruction texts are this project's own wording and are plain
parameters; only the parsing rules are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import PY_WHITESPACE, col_, let, py_strip

# Markers that switch on colon removal (compared lower-case),
# and the refusal phrases (compared case-sensitively).
CHAIN_MARKERS = ("reasoning steps", "step-by-step reasoning")
REFUSAL_PHRASES = ("cannot provide", "cannot answer", "can't provide", "can't answer")

# Own default texts.
FALLBACK_CHAIN = (
    "Reasoning steps:\n"
    "Find the objects in the picture that the question is about.\n"
    "Note the colours, sizes, positions and counts of those objects.\n"
    "Read any text or symbols that appear near them.\n"
    "Relate the noted details to what the question asks.\n"
    "State the answer in the format the question requires."
)
CONTEXT_HEADER = ("Look at the picture and carry out each numbered step below, "
                  "reporting what you find for every step.\n")
CONTEXT_STEP_LABEL = "Steps:\n"
LAST_STEP_PREFIX = "Give the final answer as follows: "
STRUCTURE_INSTRUCTION = ("Give the steps of the following text, in order, as JSON with the one field "
                         "inference_instruction, a list of strings.")
CHAIN_INSTRUCTION = ("Write the steps needed to answer the question from a picture, one step per "
                     "line, after the words 'Reasoning steps:'.")

CHAIN_SCHEMA = "struct<inference_instruction:array<string>>"


def has_marker(text: str | Column) -> Column:
    low = F.lower(col_(text))
    cond = None
    for m in CHAIN_MARKERS:
        c = F.contains(low, F.lit(m))
        cond = c if cond is None else cond | c
    return cond


def is_refusal(text: str | Column) -> Column:
    """S16 flag: any refusal phrase occurs (case-sensitive)."""
    t = col_(text)
    cond = None
    for p in REFUSAL_PHRASES:
        c = F.contains(t, F.lit(p))
        cond = c if cond is None else cond | c
    return F.coalesce(cond, F.lit(False))


def refusal_fallback(text: str | Column, fallback: str = FALLBACK_CHAIN) -> Column:
    """A refusal is replaced by the fallback chain text."""
    return F.when(is_refusal(text), F.lit(fallback)).otherwise(col_(text))


def parse_steps(text: str | Column) -> Column:
    """Chain text -> non-empty array of step lines, or null.

    With a marker, everything up to the first ':' is dropped and all other
    colons are deleted (no colon at all leaves nothing). The text is then
    stripped, split on newlines, and blank lines are removed; lines keep
    their inner indentation.
    """
    def parse(t: Column) -> Column:
        after_first_colon = F.regexp_replace(F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1), ":", "")
        body = F.when(has_marker(t), after_first_colon).otherwise(t)
        lines = F.split(py_strip(body), "\n", -1)
        return F.filter(lines, lambda x: ~x.rlike(f"^{PY_WHITESPACE}*$"))

    # The text and the parsed lines are each bound once, so a whole text is
    # scanned once per row rather than once per reference in the expression.
    return let(let(col_(text), parse), lambda kept: F.when(F.size(kept) > 0, kept))


def chain_status(steps: str | Column) -> Column:
    s = col_(steps)
    return F.when(s.isNull(), F.lit("error")).otherwise(F.lit("ok"))


def context_prompt(chain: str | Column, header: str = CONTEXT_HEADER,
                   label: str = CONTEXT_STEP_LABEL) -> Column:
    """S17 (first half): numbered steps 1..n-1 after the header."""
    c = col_(chain)
    n = F.size(c)
    head = F.slice(c, 1, F.greatest(n - 1, F.lit(0)))
    body = F.array_join(F.transform(head, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")
    return F.when(n > 0, F.concat(F.lit(header + label), body))


def last_instruction(chain: str | Column, prefix: str = LAST_STEP_PREFIX) -> Column:
    """S17 (second half): the output-format instruction from the last step."""
    c = col_(chain)
    return F.when(F.size(c) > 0, F.concat(F.lit(prefix), F.element_at(c, -1)))


def decode_structured(text: str | Column) -> Column:
    """``{"inference_instruction": [...]}`` JSON -> the step array.

    The text is read as a value inside an object whose last field must be
    reached, so text after the JSON (or a second value) gives null.
    """
    wrapped = F.concat(F.lit('{"value":'), col_(text), F.lit(',"end of text":true}'))
    whole = F.from_json(wrapped, f"struct<value:{CHAIN_SCHEMA},`end of text`:boolean>")
    return F.when(whole.getField("end of text"), whole.getField("value").getField("inference_instruction"))


def encode_structured(steps: str | Column) -> Column:
    return F.to_json(F.struct(col_(steps).alias("inference_instruction")))


def reusable(chain: str | Column) -> Column:
    """A stored chain can be reused if it is a non-empty list without nulls."""
    c = col_(chain)
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
