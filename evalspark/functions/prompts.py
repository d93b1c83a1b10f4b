"""Prompt, judge-request and chat-payload construction.

Templates are parameters: ``fill`` splits a ``{name}`` template once at
plan time into literal pieces and columns joined by ``concat``, so text
inside a question that looks like a placeholder is never substituted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import col_
from evalspark.operators.metrics import max_word_count

# Own default texts.
FINAL_TEMPLATE = ("Question: {question}\n"
                  "Information gathered from the picture:\n{extracted_info}\n"
                  "{output_format}")
STEP_TEMPLATE = ("Carry out this step on the picture: {step}\n"
                 "Findings from the earlier steps:\n{answers}")
STEPWISE_PREFIX = "Work through the question step by step before answering. "

JUDGE_INSTRUCTIONS = {
    "yes_no": ("Read the response to a yes/no question and reply with only 'yes' or 'no' "
               "to match its meaning; reply 'unclear' if it commits to neither."),
    "choice": ("Read the response to a multiple-choice question and reply with only the "
               "option it picks, as shown in the choices; reply 'unclear' if it picks none."),
    "number": ("Read the response to a question with a numeric answer and reply with only "
               "the final number or Python list it gives."),
    "free_answer": ("Compare the response with the real answer and reply 'correct', "
                    "'incorrect' or 'unclear'."),
}

# Own layouts, but for the last one.
JUDGE_TEMPLATES = {
    "yes_no": "Text to read:\n{response}",
    "choice": "Options on offer:\n{choices}Text to read:\n{response}",
    "number": "Text to read:\n{response}\nIts number or list:",
    # Fixed value: the repetition guard counts words in this layout.
    "free_answer": "Real Answer:{answer},Response:{response}",
}
REPEAT_LIMIT = 10

# Leading bytes (hex) of image formats -> media type.
IMAGE_SIGNATURES = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"),
                    ("474946383761", "image/gif"), ("474946383961", "image/gif"))


def fill(template: str, **values: str | Column) -> Column:
    """``template`` with ``{name}`` slots -> concat of literals and columns (nulls -> '')."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                pieces.append(F.lit(p))
        else:
            pieces.append(F.coalesce(col_(values[p]).cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def final_prompt(question, extracted_info, output_format, template: str = FINAL_TEMPLATE) -> Column:
    """Final answer prompt from question, gathered info and output format."""
    return fill(template, question=question, extracted_info=extracted_info, output_format=output_format)


def step_prompt(step, answers, template: str = STEP_TEMPLATE) -> Column:
    """One multi-turn step prompt with the transcript so far."""
    return fill(template, step=step, answers=answers)


def prefixed_prompt(prompt, prefix: str = STEPWISE_PREFIX) -> Column:
    """Prefix + prompt with no separator."""
    return F.concat(F.lit(prefix), col_(prompt))


def judge_text(kind, response, answer=None, choices=None,
               templates: dict[str, str] | None = None) -> Column:
    """The judge request text, chosen per row by ``kind``."""
    tpl = templates or JUDGE_TEMPLATES
    k = col_(kind)
    vals = {"response": response, "answer": answer if answer is not None else F.lit(""),
            "choices": choices if choices is not None else F.lit("")}
    expr = None
    for name, t in tpl.items():
        needed = {n: vals[n] for n in re.findall(r"\{(\w+)\}", t)}
        v = fill(t, **needed)
        expr = F.when(k == name, v) if expr is None else expr.when(k == name, v)
    return expr


def judge_instruction(kind, instructions: dict[str, str] | None = None) -> Column:
    ins = instructions or JUDGE_INSTRUCTIONS
    k = col_(kind)
    expr = None
    for name, text in ins.items():
        expr = F.when(k == name, F.lit(text)) if expr is None else expr.when(k == name, F.lit(text))
    return expr


def repetition_guard(text, limit: int = REPEAT_LIMIT) -> Column:
    """True when some space-separated word occurs more than ``limit`` times."""
    return F.coalesce(max_word_count(text) > limit, F.lit(False))


def media_type(image_b64) -> Column:
    """Media type from the leading bytes of base64 image text (null if unknown)."""
    raw = F.try_to_binary(F.substring(col_(image_b64), 1, 24), F.lit("base64"))   # 24 characters: 18 bytes
    head = F.hex(F.substring(raw, 1, 16))
    expr = None
    for sig, mt in IMAGE_SIGNATURES:
        c = head.startswith(sig)
        expr = F.when(c, F.lit(mt)) if expr is None else expr.when(c, F.lit(mt))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return expr.when(webp, F.lit("image/webp"))


def canonical_base64(text) -> Column:
    """Decode then re-encode base64 text without line breaks; invalid -> null."""
    raw = F.try_to_binary(col_(text), F.lit("base64"))
    return F.regexp_replace(F.base64(raw), "[\\r\\n]", "")


def _system_message(system) -> Column:
    return F.when(col_(system).isNotNull() & (col_(system) != ""), F.struct(
        F.lit("system").alias("role"), col_(system).alias("content")))


def _images(image, many: bool) -> Column:
    """Images of a request as an array without nulls, from one image or (``many``) an array."""
    c = col_(image)
    return F.array_compact(F.coalesce(c, F.array().cast("array<string>")) if many else F.array(c))


def _messages(system, parts: Column) -> Column:
    user = F.concat(F.lit('{"role":"user","content":['), F.array_join(parts, ","), F.lit("]}"))
    msgs = F.array_compact(F.array(F.to_json(_system_message(system)), user))
    return F.concat(F.lit("["), F.array_join(msgs, ","), F.lit("]"))


def _text_part(query) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), col_(query).alias("text")))


def payload_parts(system, query, image, image_mime: str = "image/jpeg", many: bool = False) -> Column:
    """S24 layout 1: optional system message, then the user's text part and image parts."""
    parts = F.transform(_images(image, many), lambda i: F.to_json(F.struct(
        F.lit("image_url").alias("type"),
        F.struct(F.concat(F.lit(f"data:{image_mime};base64,"), i).alias("url")).alias("image_url"))))
    return _messages(system, F.concat(F.array(_text_part(query)), parts))


def payload_flat(system, query, image, many: bool = False) -> Column:
    """S24 layout 2: a list of one flat text, system text and query under their
    labels (fixed values), followed by the images."""
    s = col_(system)
    text = F.concat(F.when(s.isNotNull() & (s != ""), F.concat(F.lit("system_prompt:\n"), s)).otherwise(F.lit("")),
                    F.lit("\nquery:\n"), F.coalesce(col_(query), F.lit("")))
    return F.to_json(F.concat(F.array(text), _images(image, many)))


def payload_media(system, query, image, many: bool = False) -> Column:
    """S24 layout 3: image parts (with detected media type) before the text part."""
    parts = F.transform(_images(image, many), lambda i: F.to_json(F.struct(
        F.lit("image").alias("type"),
        F.struct(F.lit("base64").alias("type"), media_type(i).alias("media_type"), i.alias("data")).alias("source"))))
    return _messages(system, F.concat(parts, F.array(_text_part(query))))
