"""Rule features, their score, imperative flags and the canonical rewriter."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from adagium.functions import fixed
from adagium.functions.text import collapse, first_word, flag, strip_chars


# RE2, the engine of Arrow's functions, searches long texts in one pass whatever the number of alternatives. Its word
# boundaries know ASCII alone, so other letters and digits become underscores first, as in the SQL.
_OTHER_LETTERS = r"[^\x00-\x7F\PL]|[^\x00-\x7F\P{Nd}]"
_COMMON = ("f_imperative", "f_prohibition", "f_conditional", "f_causal", "f_valuation", "f_agency")


def _prepared(texts: pa.Array) -> pa.Array:
    """Trimmed, quotes straight; letters beyond ASCII as underscores."""
    t = pc.utf8_trim(pc.fill_null(texts, ""), " ")
    for pattern, plain in (("[’‘]", "'"), ("[“”]", '"'), (_OTHER_LETTERS, "_")):
        t = pc.replace_substring_regex(t, pattern, plain)
    return t


def _hits(t: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Hits of the positive and the negative lexicon in the outcome clause."""
    second = pc.replace_substring_regex(t, r"(?s)^.*?(?:,|;| then )", "", max_replacements=1)
    clause = pc.if_else(pc.match_substring_regex(pc.utf8_trim(second, " "), r"\s"), second, t)
    return pc.count_substring_regex(clause, fixed.POSITIVE), pc.count_substring_regex(clause, fixed.NEGATIVE)


def _common(t: pa.Array, imperatives: str, conditional: str) -> list[pa.Array]:
    found = lambda p: pc.match_substring_regex(t, p)
    return [
        pc.and_not(found(rf"(?i)^(?:{imperatives})\b"), pc.ends_with(t, "?")),
        pc.or_(found(fixed.PROHIBITION), found(fixed.WASTE_NOT)),
        *map(found, (conditional, fixed.CAUSAL, fixed.VALUATION, fixed.AGENCY)),
    ]


def _struct(flags: dict[str, pa.Array], **words: pa.Array) -> pa.StructArray:
    columns = {k: v.cast(pa.int32()) for k, v in flags.items()} | words
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


@F.arrow_udf(StructType([*(StructField(c, IntegerType()) for c in _COMMON), StructField("f_valence", StringType())]))
def _features_v1(texts: pa.Array) -> pa.Array:
    t = _prepared(texts)
    p, n = _hits(t)
    valence = pc.if_else(pc.greater(p, n), "pos", pc.if_else(pc.greater(n, p), "neg", "neut"))
    return _struct(dict(zip(_COMMON, _common(t, fixed.IMPERATIVES_V1, fixed.CONDITIONAL_V1))), f_valence=valence)


FEATURES_V2 = ("f_imperative", "f_prohibition", "f_modal", "f_conditional", "f_causal", "f_valuation", "f_agency", "f_valence_pos", "f_valence_neg")


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in FEATURES_V2]))
def _features_v2(texts: pa.Array) -> pa.Array:
    t = _prepared(texts)
    p, n = _hits(t)
    flags = dict(zip(_COMMON, _common(t, fixed.IMPERATIVES_V2, fixed.CONDITIONAL_V2)))
    flags |= {"f_modal": pc.match_substring_regex(t, fixed.MODAL), "f_valence_pos": pc.greater(p, n), "f_valence_neg": pc.greater(n, p)}
    return _struct({c: flags[c] for c in FEATURES_V2})


def features_v1(c: Column) -> dict[str, Column]:
    """Six flags and the valence word: pos, neg or neut (ties) by lexicon hits in the outcome clause."""
    f = _features_v1(c)
    return {k: f[k] for k in (*_COMMON, "f_valence")}


def features_v2(c: Column) -> dict[str, Column]:
    """Nine flags; modal verbs, valence as two flags, and wider patterns."""
    f = _features_v2(c)
    return {k: f[k] for k in FEATURES_V2}


def score(f: dict[str, Column]) -> dict[str, Column]:
    """Label, triggers joined by +, and confidence, from version 1 features."""
    on = {k: v == 1 for k, v in f.items() if k != "f_valence"}
    felt = f["f_valence"] != "neut"
    command = on["f_imperative"] | on["f_prohibition"]
    outcome = (
        F.when(on["f_conditional"] & on["f_agency"], "consequential")
        .when(on["f_causal"] & on["f_agency"] & felt, "causal+valence")
        .when(on["f_agency"] & felt, "agency+valence")
    )
    fired = F.array_compact(F.array(F.when(command, "command"), F.when(on["f_valuation"], "valuation"), outcome))
    label = F.when(F.size(fired) > 0, 1).otherwise(0)
    near = command | on["f_conditional"] | on["f_causal"] | on["f_valuation"] | on["f_agency"]
    confidence = F.when((label == 1) & (command | (F.size(fired) >= 2)), "HIGH").when(label == 1, "MED").when(near, "LOW").otherwise("HIGH")
    return {"implicit_prescriptive": label, "ip_trigger": F.array_join(fired, "+"), "ip_confidence": confidence}


def prefix_flag(c: Column) -> Column:
    """A clause starts with a negation or hortative cue."""
    return flag(c.rlike(fixed.PREFIX_CUES))


def imperative_flag(c: Column) -> Column:
    """Prefix cue, 'not ..., ... not', or a starter verb as the first word."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).when(t.rlike(fixed.PREFIX_CUES) | t.rlike(fixed.NOT_NOT), 1).when(first_word(t).isin(*fixed.STARTERS), 1).otherwise(0)


def canonical_input(c: Column) -> Column:
    """Quotes stripped, white space collapsed, curly quotes and dashes unified, lead-ins and origin suffix removed."""
    t = collapse(strip_chars(F.trim(F.coalesce(c, F.lit(""))), fixed.QUOTES))
    t = F.regexp_replace(F.regexp_replace(t, "[“”‘’`]", '"'), "[–—]", "-")
    return F.regexp_replace(F.regexp_replace(t, fixed.LEAD_IN, ""), fixed.ORIGIN_SUFFIX, "")


def canonical(df: DataFrame, text: str) -> DataFrame:
    """The first matching rule rewrites the text; family, rule id, and a closing mark.

    In steps, so that the cleaned text and the rule's number are computed once.
    """
    t = F.col("__input")
    number = F.lit(0)
    for i, (_, _, pattern, _) in reversed(list(enumerate(fixed.CANONICAL_RULES, 1))):
        number = F.when(t.rlike(pattern), i).otherwise(number)
    df = df.withColumn("__input", canonical_input(F.col(text))).withColumn("__rule", number)
    out = t
    for i, (_, _, pattern, replacement) in enumerate(fixed.CANONICAL_RULES, 1):
        out = F.when(F.col("__rule") == i, F.regexp_replace(t, pattern, replacement)).otherwise(out)
    df = df.withColumn("__input", F.trim(out))
    name = lambda k, none: F.element_at(F.array(F.lit(none), *[F.lit(r[k]) for r in fixed.CANONICAL_RULES]), F.col("__rule") + 1)
    closed = F.when((t == "") | t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))
    return df.withColumns({"canonical_claim": closed, "canon_rule_family": name(1, "none"), "canon_rule_id": name(0, "")}).drop("__input", "__rule")


def hints(family: Column) -> dict[str, Column]:
    """Hint flags of a rule family."""
    names = ("canon_is_command", "canon_has_valuation", "canon_has_cause_result")
    out = {n: flag(family.isin(*[f for f, h in fixed.FAMILY_HINTS.items() if h[i]])) for i, n in enumerate(names)}
    return out | {"canon_implicit_hint": flag(family.isin(*[f for f, h in fixed.FAMILY_HINTS.items() if any(h)]))}
