"""Prompting modes as stage tables.

Each model call of a mode is one stage: build a request table with
column expressions, then attach the response table by key (J6). The
response table either holds recorded responses or is produced by a
model through a table of stored answers (``evalspark.plans.answers``). A
stage never loops over rows on the driver; the multi-turn mode with a model
loops over *step numbers* (bounded by the longest chain), each step one
distributed job that appends its answers to that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import chains as CH
from evalspark.functions import prompts as PR
from evalspark.operators import joins as J
from evalspark.operators import windows as W
from evalspark.plans.answers import AnswerTable, Call
from evalspark.sources import shared

Responder = Callable[[DataFrame], DataFrame]  # (request_id, ..., query) -> (request_id, response)


@dataclass(frozen=True)
class ModeFlags:
    chain: bool = False              # a ready chain column is supplied
    extracted_info: bool = False     # another run's extracted info is supplied
    multi_turn: bool = False
    chain_only: bool = False
    chain_only_visual: bool = False
    visual_all: bool = False
    has_image: bool = True


def resolve_mode(f: ModeFlags) -> str:
    """Validate the flags and pick the mode (first match wins)."""
    exclusive = [f.extracted_info, f.multi_turn, f.chain_only, f.chain_only_visual, f.visual_all]
    if sum(bool(x) for x in exclusive) > 1:
        raise ValueError("at most one of extracted_info, multi_turn, chain_only, "
                         "chain_only_visual, visual_all may be set")
    if not f.has_image and not f.chain_only:
        raise ValueError("an image is required unless only the chain is generated")
    if f.multi_turn and f.chain:
        return "multi_turn_ready"
    if f.extracted_info:
        return "exchange"
    if f.chain:
        return "ready_chain"
    if f.multi_turn:
        return "multi_turn_scratch"
    if f.chain_only:
        return "chain_only"
    if f.chain_only_visual:
        return "chain_only_visual"
    if f.visual_all:
        return "visual_all"
    return "chain"


def direct(items: DataFrame, responses: DataFrame, done: DataFrame | None = None,
           key: str = "item_id") -> DataFrame:
    """M1: prompt (+image) -> response; items already answered are skipped."""
    todo = J.pending(items, done, key) if done is not None else items
    req = todo.select(key, "prompt", PR.payload_parts(F.lit(None).cast("string"), F.col("prompt"),
                                                      F.col("image")).alias("payload"))
    return J.attach_responses(req, responses, key)


def stepwise(items: DataFrame, responses: DataFrame, done: DataFrame | None = None,
             key: str = "item_id", prefix: str = PR.STEPWISE_PREFIX) -> DataFrame:
    """M2: the direct mode on a prefixed prompt."""
    return direct(items.withColumn("prompt", PR.prefixed_prompt("prompt", prefix)), responses, done, key)


def chain_requests(items: DataFrame, key: str = "item_id", with_image: bool = False,
                   instruction: str | None = None) -> DataFrame:
    """M7/M8 stage 1: one chain-generation request per item (optionally with image)."""
    sys = F.lit(instruction) if instruction else F.lit(None).cast("string")
    img = F.col("image") if with_image else F.lit(None).cast("string")
    return items.select(key, PR.payload_parts(sys, F.col("prompt"), img).alias("payload"))


def parse_generations(generations: DataFrame, key: str = "item_id", attempt: str = "attempt",
                      text: str = "generation", max_attempts: int = 3) -> DataFrame:
    """M7/M8 stage 1 result: refusal fallback, step parsing, first valid attempt."""
    parsed = generations.select(key, attempt, CH.parse_steps(CH.refusal_fallback(text)).alias("chain"))
    return W.first_valid_attempt(parsed, key, attempt, "chain", max_attempts, "chain")


def visual_chain(first_generations: DataFrame, structured_responses: DataFrame, key: str = "item_id",
                 text: str = "generation", structured: str = "structured") -> DataFrame:
    """M8: chain from the image in one try; a failed parse falls back to the
    structured-output response ``{"inference_instruction": [...]}`` (S26)."""
    parsed = first_generations.select(key, CH.parse_steps(CH.refusal_fallback(text)).alias("_rules"))
    joined = J.attach_responses(parsed, structured_responses, key, response=structured, out="_structured")
    dec = CH.decode_structured("_structured")
    return joined.select(
        key, F.coalesce(F.col("_rules"), dec).alias("chain"),
        F.when(F.col("_rules").isNotNull(), F.lit("rules")).when(dec.isNotNull(), F.lit("structured"))
        .otherwise(F.lit("none")).alias("chain_source"))


def answer_with_chain(items: DataFrame, chains: DataFrame, extract_responses: DataFrame,
                      final_responses: DataFrame, key: str = "item_id") -> DataFrame:
    """M3/M4 from the merge on: context request -> extracted info -> final request -> answer."""
    staged = items.join(chains.select(key, "chain"), key, "inner")
    ctx = staged.select(key, "prompt", "chain",
                        CH.context_prompt("chain").alias("context"),
                        CH.last_instruction("chain").alias("output_format"))
    with_info = J.attach_responses(ctx, extract_responses, key, out="intermediate_response").drop("missing")
    final = with_info.withColumn("final_prompt", PR.final_prompt(
        F.col("prompt"), F.col("intermediate_response"), F.col("output_format")))
    return J.attach_responses(final, final_responses, key)


def answer_recorded(recorded: DataFrame, chains: DataFrame, key: str = "item_id") -> DataFrame:
    """M3/M4/M8 from the merge on, for rows that carry their recorded answers (prompt,
    intermediate_response, response): one join with the chains, no other."""
    staged = recorded.join(chains.select(key, "chain"), key, "inner")
    return staged.withColumns({
        "final_prompt": PR.final_prompt(F.col("prompt"), F.col("intermediate_response"), CH.last_instruction("chain")),
        "missing": F.col("response").isNull().cast("int")})


def answer_with_visual_chain(items: DataFrame, first_generations: DataFrame, structured_responses: DataFrame,
                             extract_responses: DataFrame, final_responses: DataFrame,
                             key: str = "item_id") -> DataFrame:
    """M8 whole: a chain from the image, then both answer stages on it; items
    whose chain failed in either form have no answer stage."""
    chains = visual_chain(first_generations, structured_responses, key).where(F.col("chain").isNotNull())
    return answer_with_chain(items, chains, extract_responses, final_responses, key)


def exchange(items: DataFrame, chains: DataFrame, other_run: DataFrame, final_responses: DataFrame,
             key: str = "item_id", order: str | None = None) -> DataFrame:
    """M6: another run's extracted info + this chain's output format -> answer (one call).
    Of an item's rows in the other run the latest by ``order`` counts; an item without one has no info."""
    staged = J.attach_exchange(items.join(chains.select(key, "chain"), key, "inner"), other_run, key, order=order)
    info = F.array_join(F.coalesce(F.col("exchange_info"), F.array().cast("array<string>")), "\n")
    final = staged.select(key, "prompt", "chain", F.col("exchange_info"),
                          PR.final_prompt(F.col("prompt"), info, CH.last_instruction("chain")).alias("final_prompt"))
    return J.attach_responses(final, final_responses, key)


def multi_turn_recorded(steps: DataFrame, items: DataFrame, key: str = "item_id", step: str = "step",
                        text: str = "text", response: str = "response") -> DataFrame:
    """M5 with recorded step responses, one pass: step prompts and the final prompt.

    ``steps`` holds one row per (item, step) with the chain step text and
    the recorded response to that step. All but the last step get a step
    prompt with the transcript so far; the last step's row carries the
    final prompt built from the full transcript.
    """
    t = W.running_transcript(steps, key, step, response, "transcript")
    last = F.max(F.col("position")).over(Window.partitionBy(key))
    t = t.withColumn("is_last", F.col("position") == last)
    joined = t.join(items.select(key, "prompt"), key, "inner")
    return joined.select(
        key, step, "is_last",
        F.when(~F.col("is_last"), PR.step_prompt(F.col(text), F.col("transcript"))).alias("step_prompt"),
        F.when(F.col("is_last"), PR.final_prompt(F.col("prompt"), F.col("transcript"), F.col(text)))
        .alias("final_prompt"))


def request_id(key: str, stage: str | Column) -> Column:
    """Key of one model call of an item: the item's key, a slash and the stage."""
    return F.concat(F.col(key).cast("string"), F.lit("/"), F.lit(stage) if isinstance(stage, str) else stage)


def request_parts(request: str = "request_id") -> tuple[Column, Column, Column]:
    """Item key (as text), kind of call (c chain, v visual chain, s step, f final) and number of a call's key."""
    at = F.regexp_extract(F.col(request), "^(?s)(.*)/([cvsf])([0-9]*)$", 1)
    number = F.regexp_extract(F.col(request), "/[cvsf]([0-9]*)$", 1).try_cast("int")
    return at, F.regexp_extract(F.col(request), "/([cvsf])[0-9]*$", 1), number


def generate_chains(items: DataFrame, model: Responder | Call, answers: AnswerTable, key: str = "item_id",
                    max_attempts: int = 3, instruction: str = CH.CHAIN_INSTRUCTION) -> DataFrame:
    """M7 with a model: up to ``max_attempts`` generations an item, each asked only
    where those before failed to parse (N2, S15, S16).

    Every attempt is one distributed job over the items still without a chain.
    Returns key, chain, chosen_attempt, attempts, status.
    """
    for k in range(1, max_attempts + 1):
        todo = items if k == 1 else J.pending(items, finished_chains(items, answers, key, k - 1), key)
        answers.ask(todo.select(request_id(key, f"c{k}").alias("request_id"),
                                F.concat_ws("\n", F.lit(instruction), F.col("prompt")).alias("query")), model_of(model))
    return _tried(items, answers, key, max_attempts)


def _tried(items: DataFrame, answers: AnswerTable, key: str, upto: int) -> DataFrame:
    """The first valid of the generations stored for each item."""
    calls = items.select(key, F.explode(F.array(*(F.lit(k) for k in range(1, upto + 1)))).alias("attempt"))
    got = calls.withColumn("request_id", request_id(key, F.concat(F.lit("c"), F.col("attempt").cast("string")))).join(
        answers.latest("string"), "request_id", "left")
    parsed = got.withColumn("chain", CH.parse_steps(CH.refusal_fallback("response")))
    return W.first_valid_attempt(parsed, key, "attempt", "chain", upto, "chain")


def generate_visual_chains(items: DataFrame, model: Responder | Call, answers: AnswerTable,
                           structured: Responder | Call | None = None, key: str = "item_id",
                           instruction: str = CH.CHAIN_INSTRUCTION) -> DataFrame:
    """M8/M9 with a model and the image: one generation an item; where its text does not
    parse, a second call asks for that text as structured output (S26).

    Returns key, chain, chain_form ('rules', 'structured' or 'none').
    """
    first = items.select(request_id(key, "v1").alias("request_id"), PR.payload_parts(
        F.lit(instruction), F.col("prompt"), F.col("image")).alias("query"))
    got = answers.ask(first, model_of(model)).withColumn("rules", CH.parse_steps(CH.refusal_fallback("response")))
    rows = items.select(key, request_id(key, "v1").alias("request_id")).join(got, "request_id", "left")
    again = rows.where(F.col("rules").isNull() & F.col("response").isNotNull()).select(
        request_id(key, "v2").alias("request_id"),
        F.concat_ws("\n", F.lit(CH.STRUCTURE_INSTRUCTION), F.col("response")).alias("query"))
    decoded = answers.ask(again, model_of(structured or model)).select(
        F.col("request_id").alias("_second"), CH.decode_structured("response").alias("decoded"))
    both = rows.join(decoded, request_id(key, "v2") == F.col("_second"), "left")
    return both.select(key, F.coalesce("rules", "decoded").alias("chain"),
                       F.when(F.col("rules").isNotNull(), F.lit("rules")).when(F.col("decoded").isNotNull(), F.lit("structured"))
                       .otherwise(F.lit("none")).alias("chain_form"))


def enrich(items: DataFrame, model: Responder | Call, answers: AnswerTable, key: str = "item_id", old: str = "old_chain",
           visual: bool = False, structured: Responder | Call | None = None) -> DataFrame:
    """M9 (J4, S28, W2): the items with a chain each: a reusable stored one is kept, the
    others are generated, from the question or (``visual``) from question and image.

    Only items without a reusable chain are asked for. The finished generations of a
    run that stops are in the answer table: ``finished_chains`` reads them, and the
    next run asks for the rest.
    """
    todo = items.where(~CH.reusable(F.col(old)))
    chains = (generate_visual_chains(todo, model, answers, structured, key) if visual
              else generate_chains(todo, model, answers, key))
    return J.fill_missing(items, chains.select(key, "chain"), key, old, "chain", "chain")


def finished_chains(items: DataFrame, answers: AnswerTable, key: str = "item_id", max_attempts: int = 3) -> DataFrame:
    """Key and chain of the items whose generation is stored, whatever became of the run."""
    return _tried(items, answers, key, max_attempts).where(F.col("chain").isNotNull()).select(key, "chain")


def transcripts(items: DataFrame, answers: AnswerTable, upto: int | None = None, key: str = "item_id",
                chain: str = "chain") -> DataFrame:
    """key, transcript: the answers to an item's steps so far (all but the last
    step's, or the first ``upto``), as the answer table holds them."""
    inner = F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0)))
    steps = items.select(key, F.posexplode(F.slice(inner, 1, upto) if upto is not None else inner).alias("p", "_")).select(
        key, (F.col("p") + 1).alias("step"))
    got = steps.withColumn("request_id", request_id(key, F.concat(F.lit("s"), F.col("step").cast("string")))).join(
        answers.latest("string"), "request_id", "left")
    line = F.concat(F.lit("step"), F.col("step").cast("string"), F.lit(":"), F.coalesce("response", F.lit("")), F.lit("\n"))
    return got.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("step", line.alias("line")))).alias("t")).select(
        key, F.array_join(F.transform("t", lambda x: x["line"]), "").alias("transcript"))


def multi_turn(items: DataFrame, model: Responder | Call, answers: AnswerTable | None = None, key: str = "item_id",
               chain: str = "chain", stop_after: int | None = None) -> DataFrame:
    """M5 with a model: one distributed job per step number.

    The state between steps is the answer table alone, to which each step
    appends one row per item that still has steps; the transcript in a prompt
    is read from it. So the plan does not grow with the steps, nothing answered
    is asked again, and a run that stops (``stop_after`` steps, or by failing)
    goes on where it stood when it is called again with the same table. Only
    the longest chain's length (one number) reaches the driver.

    Returns key, transcript, query, response, error; if stopped, the
    transcript so far without a query and response.
    """
    table = answers or AnswerTable(items.sparkSession)
    rows = items.select(key, "prompt", chain).filter(F.size(chain) > 0)
    longest = rows.agg(F.max(F.size(chain))).first()[0] or 0

    def so_far(upto: int | None) -> DataFrame:
        active = rows if upto is None else rows.filter(F.size(chain) > upto + 1)
        return active.join(transcripts(active, table, upto, key, chain), key, "left").withColumn(
            "transcript", F.coalesce("transcript", F.lit("")))

    for k in range(1, longest):
        if stop_after is not None and k > stop_after:
            return so_far(None).select(key, "transcript", *(F.lit(None).cast("string").alias(c)
                                                            for c in ("query", "response", "error")))
        active = so_far(k - 1)
        table.ask(active.select(request_id(key, f"s{k}").alias("request_id"), PR.step_prompt(
            F.element_at(chain, k), F.col("transcript")).alias("query")), model_of(model))
    final = so_far(None).select(key, "transcript", request_id(key, "f").alias("request_id"), PR.final_prompt(
        F.col("prompt"), F.col("transcript"), F.element_at(chain, -1)).alias("query"))
    got = table.ask(final.select("request_id", "query"), model_of(model))
    return final.join(got, "request_id", "left").drop("request_id")


def multi_turn_live(items: DataFrame, responder: Responder, key: str = "item_id",
                    chain: str = "chain", answers: AnswerTable | None = None) -> DataFrame:
    """M5 on ready chains with a live responder."""
    return multi_turn(items, responder, answers, key, chain)


def multi_turn_scratch(items: DataFrame, chain_model: Responder | Call, model: Responder | Call,
                       answers: AnswerTable, key: str = "item_id", stop_after: int | None = None) -> DataFrame:
    """M5 from scratch: chains are generated, then asked step by step.

    Both stages keep their answers in one table, so either resumes. Items
    without a valid chain after all attempts stay, with status 'exhausted'.
    """
    chains = shared.stored(generate_chains(items, chain_model, answers, key), "chains")
    ready = items.select(key, "prompt").join(chains.select(key, "chain"), key).where(F.col("chain").isNotNull())
    told = multi_turn(ready, model, answers, key, "chain", stop_after)
    return chains.join(told, key, "left")


def model_of(model: Responder | Call) -> Responder | Call:
    """The call behind a responder, if it has one."""
    return getattr(model, "model", model)
