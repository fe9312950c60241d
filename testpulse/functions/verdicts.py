"""Scorer seam: prompts out, verdicts in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from testpulse.functions import fixed

# What a scorer's confidence may look like as text: a plain number, or an
# infinity or not-a-number word (both clamp to a bound).
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def clamp(confidence: Column) -> Column:
    """Confidence within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def parse(
    provider: Column,
    model_requested: Column,
    model_returned: Column,
    finish_reason: Column,
    content: Column,
    call_error: Column,
    max_tokens: int = 4096,
) -> Column:
    """Struct (category, evidence, confidence, classified_by) of one response.

    Four outcomes are told apart by the prefix of ``classified_by``: a verdict
    (``llm``), a cut-off answer (``llm-truncated``), an answer that is not the
    expected JSON (``llm-parse-error``) and a failed call (``llm-fallback``).
    """
    model = F.coalesce(model_returned, model_requested)
    # try_parse_json accepts text after the document, so its end is checked here.
    is_object = content.rlike(r"^\s*\{[\s\S]*\}\s*$")
    tree = F.try_parse_json(content)
    is_json = tree.isNotNull() & (
        is_object | content.rlike(r"^\s*(\[[\s\S]*\]|\"[\s\S]*\"|[^\s{\[\"]+)\s*$")
    )

    def field(name):
        return F.get_json_object(content, "$." + name)

    def present(name):
        # a JSON null is there, but has no text
        return F.try_variant_get(tree, "$." + name, "variant").isNotNull()

    def is_text(name):
        return F.schema_of_variant(F.try_variant_get(tree, "$." + name, "variant")) == "STRING"

    word = F.upper(field("category"))
    category = F.when(word.isin(*fixed.CATEGORIES), word).otherwise("FLAKY")
    evidence = F.when(present("evidence"), field("evidence")).otherwise(fixed.DEFAULT_EVIDENCE)
    number = field("confidence")
    number = (
        F.when(~present("confidence"), F.lit(0.5))
        .when(number.isin("true", "false") & ~is_text("confidence"),
              (number == "true").cast("double"))
        .when(number.rlike(_NUMBER), F.trim(number).try_cast("double"))
    )

    def outcome(kind, category, evidence, confidence, by_model):
        return F.struct(
            category.alias("category"),
            evidence.alias("evidence"),
            confidence.alias("confidence"),
            F.concat_ws(":", F.lit(kind), provider, by_model).alias("classified_by"),
        )

    def degraded(kind, evidence, by_model=model):
        return outcome(kind, F.lit("FLAKY"), evidence, F.lit(0.5), by_model)

    def failed(what, why):
        return degraded(
            "llm-fallback",
            F.concat(F.lit(what + " ("), provider, F.lit("): "), why, F.lit("; defaulted to flaky")),
            model_requested,
        )

    cut_off = (
        f"LLM response truncated (finish_reason=length, max_tokens={max_tokens}); "
        "no verdict extracted, defaulted to flaky"
    )
    no_text_category = present("category") & ~is_text("category")
    return (
        F.when(call_error.isNotNull(), failed("LLM call failed", call_error))
        .when(content.isNull(), degraded("llm-parse-error", F.lit(fixed.NO_CHOICE_EVIDENCE)))
        .when(finish_reason == "length", degraded("llm-truncated", F.lit(cut_off)))
        .when(~is_json, degraded("llm-parse-error", F.lit(fixed.BAD_JSON_EVIDENCE)))
        .when(~is_object, failed("LLM error", F.lit("answer is not an object")))
        .when(no_text_category, failed("LLM error", F.lit("category is not text")))
        .when(number.isNull(), degraded("llm-parse-error", F.lit(fixed.BAD_JSON_EVIDENCE)))
        .otherwise(outcome("llm", category, evidence, clamp(number), model))
    )


def prompt(test_name: Column, message: Column, stack: Column, context: Column) -> Column:
    """Prompt for one ambiguous failure.  Nothing is cut: how much fits is the scorer's affair."""
    head = F.concat(
        F.lit(fixed.PROMPT_HEAD),
        F.lit("\nTest name: "), test_name,
        F.lit("\nError message: "), message,
        F.lit("\nStack trace: "), stack,
    )
    tail = F.lit("\n\n" + fixed.PROMPT_TAIL)
    whole = F.concat(head, F.lit("\nCross-run context: "), context, tail)
    return F.when(context.isNull(), F.concat(head, tail)).otherwise(whole)
