"""Prompts for language models and parsers of their replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adagium.functions import fixed


def salvage_label(c: Column) -> Column:
    """Prescriptive, descriptive or '' from a free reply: a label word, its short form, then a lone 0 or 1."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    digit = F.regexp_extract(low, r"(?<!\d)([01])(?!\d)", 1)
    pre, desc = fixed.FORM_WORDS
    return (
        F.when(low.contains(pre), pre).when(low.contains(desc), desc)
        .when(low.rlike(r"\bpre\b"), pre).when(low.rlike(r"\bdesc\b"), desc)
        .when(digit == "0", pre).when(digit == "1", desc).otherwise("")
    )


def two_lines(c: Column) -> dict[str, Column]:
    """The form and the implicit line, 'unknown' where missing."""
    pick = lambda p: F.coalesce(F.nullif(F.lower(F.regexp_extract(c, p, 1)), F.lit("")), F.lit("unknown"))
    return {"form": pick(fixed.FORM_LINE), "implicit": pick(fixed.IMPLICIT_LINE)}


def json_label(c: Column) -> Column:
    """0 or 1 from the whole reply as JSON, from any {...} in it, else after the word label; null if none."""
    tries = F.concat(F.array(c), F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\})"), 1))
    values = F.transform(tries, lambda t: F.get_json_object(t, "$.label").try_cast("int"))
    found = F.try_element_at(F.filter(values, lambda v: v.isin(0, 1)), F.lit(1))
    return F.coalesce(found, F.nullif(F.regexp_extract(c, fixed.LABEL_NEAR, 1), F.lit("")).cast("int"))


def json_code(c: Column, allowed: Column) -> Column:
    """The code of a JSON reply if it is allowed, else the first code-like text if allowed, else ''."""
    said = F.get_json_object(F.regexp_extract(c, r"(?s)\{.*\}", 0), "$.code")
    seen = F.regexp_extract(c, fixed.SALVAGE_CODE, 0)
    return F.when(F.array_contains(allowed, said), said).when(F.array_contains(allowed, seen), seen).otherwise("")


def line_code(c: Column, allowed: Column) -> Column:
    """The code of a 'CODE:' line, '' unless it is allowed."""
    said = F.regexp_extract(c, fixed.CODE_LINE, 1)
    return F.when(F.array_contains(allowed, said), said).otherwise("")


def options(codes: Column) -> Column:
    """Array of (code, text) as lines 'code: text'."""
    return F.array_join(F.transform(codes, lambda x: F.concat(x["code"], F.lit(": "), x["text"])), "\n")


def prompt(instruction: str, text: Column, choices: Column | None = None) -> Column:
    """Instruction, options if any, and the quoted text."""
    parts = [F.lit(instruction), *([choices] if choices is not None else []), F.concat(F.lit('Text: "'), text, F.lit('"'))]
    return F.concat_ws("\n\n", *parts)


def mock_cue_label(c: Column) -> Column:
    """Stand-in labeller: prescriptive if a command cue occurs."""
    low = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    found = F.lit(False)
    for cue in fixed.COMMAND_CUES:
        found = found | low.contains(cue)
    return F.when(found, fixed.FORM_WORDS[0]).otherwise(fixed.FORM_WORDS[1])


def mock_sum_label(c: Column) -> dict[str, Column]:
    """Stand-in labeller: code points' sum modulo 2 and 3."""
    points = F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1), lambda x: F.ascii(x).cast("long"))
    total = F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x)
    return {"form": F.when(total % 2 == 0, "prescriptive").otherwise("descriptive"), "implicit": F.when(total % 3 == 0, "yes").otherwise("no")}
