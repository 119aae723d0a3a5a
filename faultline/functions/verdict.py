"""Verdicts: recovery of a model's JSON reply, its validation, and the rule-based fallback."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline.functions.text import strip
from faultline.schemas import CATEGORIES, RECOMMENDATION, SEVERITIES

# What the fallback says.
MATCHED_CONFIDENCE, UNMATCHED_CONFIDENCE = 0.6, 0.2
UNKNOWN_CAUSE = "Unable to determine root cause from available information"
UNKNOWN_SUMMARY = "Unknown error - manual investigation required"
UNKNOWN_ACTION = "Review full logs manually"
# Priority words.
PRIORITY_WORDS = {"critical": 1, "immediate": 1, "high": 2, "medium": 3, "low": 4}
DEFAULT_PRIORITY = 3

VERDICT_TYPE = (
    "struct<error_category:string,severity:string,root_cause:string,root_cause_summary:string,confidence:double,"
    f"evidence:array<string>,contributing_factors:array<string>,recommendations:array<{RECOMMENDATION}>,"
    "immediate_action:string>"
)
_JSON_OPTIONS = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}
_FENCE = "```"


def strip_fence(reply: Column) -> Column:
    """The text from the first json fence (else the first fence) to the last fence after it; all of it if unclosed."""
    def inside(mark: str) -> Column:
        rest = F.substr(reply, F.locate(mark, reply) + F.lit(len(mark)))
        closing = F.length(rest) - F.locate(_FENCE[::-1], F.reverse(rest)) - F.lit(len(_FENCE) - 1)
        return F.when(rest.contains(_FENCE), F.substr(rest, F.lit(1), closing)).otherwise(rest)

    return (
        F.when(reply.contains(_FENCE + "json"), inside(_FENCE + "json"))
        .when(reply.contains(_FENCE), inside(_FENCE))
        .otherwise(reply)
    )


def outermost_object(text: Column) -> Column:
    """From the first ``{`` to the brace that balances it, counting every brace; null if there is none.

    The text is cut at closing braces, so the fold takes one step per closing brace and not one per character.
    """
    rest = F.substr(text, F.locate("{", text))
    pieces = F.split(rest, r"\}", -1)
    opened = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("step"), F.lit(0).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + opened(piece) - 1
        at = state["step"] + 1
        end = F.when(state["end"] > 0, state["end"]).when(depth == 0, at).otherwise(F.lit(0))
        return F.struct(depth.cast("int").alias("depth"), at.alias("step"), end.cast("int").alias("end"))

    # The last piece has no closing brace behind it.
    end = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)["end"]
    found = F.concat(F.array_join(F.slice(pieces, 1, end), "}"), F.lit("}"))
    return F.when(text.contains("{") & (end > 0), found)


def parse_whole(text: Column) -> Column:
    """The text as one JSON value; null if anything follows it."""
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>", _JSON_OPTIONS)
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))


def _type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(value: Column, name: str, dtype: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", dtype)


def parse_priority(value: Column) -> Column:
    """Priority 1 to 5 from a variant: whole numbers and whole-number texts are clamped, booleans count as 1, words
    are looked up, everything else (fractions too) is 3."""
    kind = _type_of(value)
    # A whole number beyond 64 bits is a wide decimal; a narrow decimal was written with a point.
    number = F.try_variant_get(value, "$", "string").try_cast("decimal(38,0)")
    text = F.try_variant_get(value, "$", "string")
    whole_text = strip(text).rlike(r"^[+-]?\d+$")
    clamped = F.greatest(F.lit(1), F.least(F.lit(5), number)).cast("int")
    word = F.lit(DEFAULT_PRIORITY)
    for name, priority in PRIORITY_WORDS.items():
        word = F.when(F.lower(text) == name, F.lit(priority)).otherwise(word)
    from_text = F.when(whole_text, F.greatest(F.lit(1), F.least(F.lit(5), strip(text).try_cast("decimal(38,0)"))).cast("int"))
    return (
        F.when(kind == "BOOLEAN", F.lit(1))
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), clamped)
        .when(kind == "STRING", F.coalesce(from_text, word))
        .otherwise(F.lit(DEFAULT_PRIORITY))
    )


def _texts(value: Column, name: str) -> tuple[Column, Column]:
    """(valid, texts): the field may be missing, but else must be an array of texts."""
    field = _field(value, name, "variant")
    kind = _type_of(field)
    valid = field.isNull() | kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_has_null(field)
    return valid, F.coalesce(_field(value, name, "array<string>"), F.array().cast("array<string>"))


def _has_null(field: Column) -> Column:
    items = F.try_variant_get(field, "$", "array<variant>")
    return F.coalesce(F.exists(items, lambda item: F.is_variant_null(item)), F.lit(False))


def typed_verdict(value: Column) -> Column:
    """The variant as a verdict, or null if any rule is broken: known enums, texts, confidence within [0, 1]."""
    is_object = F.coalesce(_type_of(value).startswith("OBJECT<"), F.lit(False))
    category, severity = _field(value, "error_category", "string"), _field(value, "severity", "string")
    cause, summary = _field(value, "root_cause", "variant"), _field(value, "root_cause_summary", "variant")
    confidence_kind = _type_of(_field(value, "confidence", "variant"))
    confidence = _field(value, "confidence", "string").try_cast("double")
    is_number = confidence_kind.isin("BIGINT", "DOUBLE", "STRING", "FLOAT") | confidence_kind.startswith("DECIMAL")
    evidence_ok, evidence = _texts(value, "evidence")
    factors_ok, factors = _texts(value, "contributing_factors")
    action = _field(value, "immediate_action", "variant")
    action_ok = action.isNull() | _type_of(action).isin("STRING", "VOID")
    raw = _field(value, "recommendations", "variant")
    items = F.try_variant_get(raw, "$", "array<variant>")
    items_ok = raw.isNull() | (
        _type_of(raw).startswith("ARRAY<")
        & ~F.exists(F.coalesce(items, F.array().cast("array<variant>")),
                    lambda item: ~_type_of(item).startswith("OBJECT<"))
    )
    recommendations = F.transform(
        F.coalesce(items, F.array().cast("array<variant>")),
        lambda item: F.struct(
            F.coalesce(_field(item, "action", "string"), F.lit("")).alias("action"),
            F.coalesce(
                parse_priority(_field(item, "priority", "variant")), F.lit(DEFAULT_PRIORITY)
            ).alias("priority"),
            _field(item, "estimated_effort", "string").alias("estimated_effort"),
            F.coalesce(_field(item, "automated", "boolean"), F.lit(False)).alias("automated"),
        ),
    )
    valid = (
        is_object
        & category.isin(CATEGORIES) & severity.isin(SEVERITIES)
        & (_type_of(cause) == "STRING") & (_type_of(summary) == "STRING")
        & is_number & confidence.between(0.0, 1.0)
        & evidence_ok & factors_ok & action_ok & items_ok
    )
    verdict = F.struct(
        category.alias("error_category"), severity.alias("severity"),
        _field(value, "root_cause", "string").alias("root_cause"),
        _field(value, "root_cause_summary", "string").alias("root_cause_summary"),
        confidence.alias("confidence"), evidence.alias("evidence"), factors.alias("contributing_factors"),
        recommendations.alias("recommendations"), _field(value, "immediate_action", "string").alias("immediate_action"),
    )
    return F.when(F.coalesce(valid, F.lit(False)), verdict.cast(VERDICT_TYPE))


# Fixed value: matches quoted as evidence.
MAX_EVIDENCE = 3


def fallback_verdict(primary: Column, evidence: int = MAX_EVIDENCE) -> Column:
    """The verdict of the primary family, or the unknown one."""
    no_texts = F.array().cast("array<string>")
    recommendation = lambda action: F.array(F.struct(
        action.alias("action"), F.lit(1).alias("priority"), F.lit(None).cast("string").alias("estimated_effort"),
        F.lit(False).alias("automated"),
    ))
    matched = F.struct(
        primary["category"].alias("error_category"), primary["severity"].alias("severity"),
        primary["description"].alias("root_cause"), primary["description"].alias("root_cause_summary"),
        F.lit(MATCHED_CONFIDENCE).alias("confidence"),
        F.transform(F.slice(primary["matches"], 1, evidence), lambda m: F.concat(F.lit("Pattern match: "), m)).alias("evidence"),
        no_texts.alias("contributing_factors"), recommendation(primary["recommendation"]).alias("recommendations"),
        F.lit(None).cast("string").alias("immediate_action"),
    ).cast(VERDICT_TYPE)
    unmatched = F.struct(
        F.lit("unknown").alias("error_category"), F.lit("medium").alias("severity"),
        F.lit(UNKNOWN_CAUSE).alias("root_cause"), F.lit(UNKNOWN_SUMMARY).alias("root_cause_summary"),
        F.lit(UNMATCHED_CONFIDENCE).alias("confidence"), no_texts.alias("evidence"),
        no_texts.alias("contributing_factors"), recommendation(F.lit(UNKNOWN_ACTION)).alias("recommendations"),
        F.lit(None).cast("string").alias("immediate_action"),
    ).cast(VERDICT_TYPE)
    return F.when(primary.isNotNull(), matched).otherwise(unmatched)
