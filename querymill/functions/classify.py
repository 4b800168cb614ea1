"""Is a query worth a web search? The rule-based answer, and the reading of a model's answer."""

from pyspark.sql import Column, functions as F

from querymill.functions.replies import as_float, extract_json, field, field_type, let, parse_json
from querymill.functions.text import SPACE
from querymill.schemas import CLASSIFICATION, is_confidence, is_query_status

# Substrings that decide the class, and the texts given as reasons.
COMMAND_PATTERNS = [
    "walk my", "add to", "send email", "book appointment",
    "call", "text", "schedule", "remind me", "set alarm",
    "play music", "turn on", "turn off",
]
SEARCH_PATTERNS = [
    "what", "how", "why", "when", "where", "who", "which",
    "best", "top", "compare", "vs", "versus", "difference",
    "explain", "guide", "tutorial", "learn", "help",
]
REASON_COMMAND = "Query appears to be a personal command or too short"
REASON_SEARCH = "Contains question words or information-seeking patterns"
REASON_OTHER = "Basic validation passed (fallback classification)"
REASON_MODEL = "Classified by Gemini"
SUGGESTION = "Try asking a question that can be answered by web search"
# Fewer than three characters between the white space at both ends.
TOO_SHORT = rf"\A[{SPACE}]*[^{SPACE}]{{0,2}}[{SPACE}]*\z"


def _has_any(text: Column, patterns) -> Column:
    """One pass over the text for all patterns; none of them holds a regex character."""
    return text.rlike("|".join(patterns))


def _verdict(status, confidence, reason, suggestions=None) -> Column:
    suggested = F.array(F.lit(suggestions)) if suggestions else F.lit(None)
    return F.struct(
        F.lit(status).alias("status"),
        F.lit(confidence).alias("confidence"),
        F.lit(reason).alias("reason"),
        suggested.cast("array<string>").alias("suggested_improvements"),
    )


def classify_heuristic(query: Column) -> Column:
    """Plain substring containment, no word boundaries; command patterns win over search patterns."""
    lowered = F.lower(query)
    return (
        F.when(
            _has_any(lowered, COMMAND_PATTERNS) | query.rlike(TOO_SHORT),
            _verdict("invalid", 0.7, REASON_COMMAND, SUGGESTION),
        )
        .when(_has_any(lowered, SEARCH_PATTERNS), _verdict("valid", 0.8, REASON_SEARCH))
        .otherwise(_verdict("valid", 0.6, REASON_OTHER))
    )


def parse_classification(query: Column, reply: Column) -> Column:
    """A model's JSON answer; whatever cannot be used falls back to the rules above."""
    return let(parse_json(extract_json(reply)), lambda doc: _read_reply(doc, query))


def _read_reply(doc: Column, query: Column) -> Column:
    status, confidence = field(doc, "status", "string"), as_float(doc, "confidence")
    reason_type, ideas_type = field_type(doc, "reason"), field_type(doc, "suggested_improvements")
    ideas = field(doc, "suggested_improvements", "array<string>")
    usable = (
        (field_type(doc, "status") == "STRING")
        & is_query_status(status)
        & is_confidence(confidence)
        & (reason_type.isNull() | reason_type.isin("VOID", "STRING"))
        & (ideas_type.isNull() | ideas_type.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"))
        & F.coalesce(~F.exists(ideas, lambda x: x.isNull()), F.lit(True))
    )
    parsed = F.struct(
        status.alias("status"),
        confidence.alias("confidence"),
        F.when(reason_type.isNull(), REASON_MODEL).otherwise(field(doc, "reason", "string")).alias("reason"),
        ideas.alias("suggested_improvements"),
    )
    return F.when(F.coalesce(usable, F.lit(False)), parsed.cast(CLASSIFICATION)).otherwise(
        classify_heuristic(query).cast(CLASSIFICATION)
    )
