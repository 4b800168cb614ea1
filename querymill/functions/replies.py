"""Reading JSON out of model replies with the VARIANT functions.

Dynamic typing matters here (``"false"`` is true, ``"0.9"`` is a number), so the type of each
JSON value is looked at beside the value itself.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from querymill.functions.text import split_sentences, strip

# Texts and limits of the fallback rules.
REASON_JUDGE = "Assessed by Gemini"
REASON_INVALID = "Invalid LLM response"
REASON_PARSE = "Parse error"
REASON_ERROR = "LLM error: "
BULLET_LINE = r"^(•|-|\*|[1-7]\.)"
BULLET_LEAD = r"^[•\-*1-9. ]+"
STOCK_POINTS = ["Summary generated from available sources", "Information processed successfully"]
MAX_POINTS = 7
TEXT_CONFIDENCE = 0.5
FLOAT_TEXT = r"(?i)^[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?$|^[+-]?(inf|infinity|nan)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_json(reply: Column) -> Column:
    """From the first ``{`` to the first ``}`` after it; the whole trimmed text if there is none."""
    found = F.regexp_extract(reply, r"\{[^}]*\}", 0)
    return F.when(found != "", found).otherwise(strip(reply))


def parse_json(text: Column) -> Column:
    """VARIANT of exactly one JSON value, null for anything else.

    The brackets make the parser see text after the value, which it would pass over otherwise.
    """
    boxed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(boxed, lambda values: F.when(F.size(values) == 1, F.get(values, F.lit(0))))


def field(doc: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", kind)


def field_type(doc: Column, name: str) -> Column:
    """SQL name of the value's type, ``VOID`` for JSON null, null for a missing field."""
    return F.schema_of_variant(field(doc, name, "variant"))


def is_object(doc: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))


def as_float(doc: Column, name: str) -> Column:
    """Number, boolean or number-like text as a double; null where no number can be made of it."""
    kind = field_type(doc, name)
    text = strip(field(doc, name, "string"))
    from_text = F.when(text.rlike(FLOAT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(_is_number(kind) | (kind == "BOOLEAN"), field(doc, name, "double")).when(
        kind == "STRING", from_text
    )


def truth(doc: Column, name: str) -> Column:
    """Truth of a JSON value: empty text, zero, null and empty collections are false."""
    kind = field_type(doc, name)
    return (
        F.when(kind == "BOOLEAN", field(doc, name, "boolean"))
        .when(kind == "STRING", F.length(field(doc, name, "string")) > 0)
        .when(_is_number(kind), field(doc, name, "double") != 0)
        .when(kind == "VOID", F.lit(False))
        .otherwise(~field(doc, name, "string").isin("[]", "{}"))
    )


def parse_verdict(reply: Column, error: Column | None = None) -> Column:
    """Judge reply to (is_similar, confidence, reason).

    Every failure reads (true, 0.5, why): below the usual cut, so a failure rejects.
    """
    error = F.lit(None).cast("string") if error is None else error
    return let(parse_json(extract_json(reply)), lambda doc: _verdict(doc, reply, error))


def _verdict(doc: Column, reply: Column, error: Column) -> Column:
    confidence, kind = as_float(doc, "confidence"), field_type(doc, "confidence")
    complete = field_type(doc, "is_similar").isNotNull() & kind.isNotNull()

    def failure(reason: Column) -> Column:
        return F.struct(F.lit(True).alias("is_similar"), F.lit(0.5).alias("confidence"), reason.alias("reason"))

    return (
        F.when(error.isNotNull(), failure(F.concat(F.lit(REASON_ERROR), error)))
        .when(reply.isNull(), failure(F.lit(REASON_PARSE)))
        .when(doc.isNull(), failure(F.lit(REASON_PARSE)))
        .when(~is_object(doc) | ~complete, failure(F.lit(REASON_INVALID)))
        .when(confidence.isNull(), failure(F.lit(REASON_PARSE)))
        .otherwise(
            F.struct(
                truth(doc, "is_similar").alias("is_similar"),
                confidence.alias("confidence"),
                F.when(field_type(doc, "reason").isNull(), REASON_JUDGE)
                .otherwise(field(doc, "reason", "string"))
                .alias("reason"),
            )
        )
    )


def summary_from_text(reply: Column) -> Column:
    """Free text as a summary: its bullets, else its first sentences, else stock lines."""
    return let(strip(reply), _read_text)


def _read_text(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x.rlike(BULLET_LINE))
    bullets = F.filter(
        F.transform(lines, lambda x: strip(F.regexp_replace(x, BULLET_LEAD, ""))), lambda x: F.length(x) > 10
    )
    sentences = F.transform(
        F.filter(
            F.transform(split_sentences(text, 5), strip),
            lambda x: (F.length(x) > 20) & (F.length(x) < 200),
        ),
        lambda x: F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit("."))),
    )
    stock = F.array(*[F.lit(p) for p in STOCK_POINTS])
    plain = let(sentences, lambda found: F.when(F.size(found) > 0, found).otherwise(stock))
    points = let(
        bullets, lambda found: F.when(F.size(found) > 0, F.slice(found, 1, MAX_POINTS)).otherwise(plain)
    )
    return _summary(text, points, F.lit(TEXT_CONFIDENCE))


def _summary(summary, key_points, confidence, error=None) -> Column:
    return F.struct(
        summary.cast("string").alias("summary"),
        key_points.cast("array<string>").alias("key_points"),
        confidence.cast("double").alias("confidence"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


def _strip_fences(reply: Column) -> Column:
    opened = F.regexp_replace(F.regexp_replace(strip(reply), "^```json", ""), "^```", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def _point_text(value: Column) -> Column:
    """One key point as text: booleans capitalised, whole-valued doubles with their ``.0``."""
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    return (
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when((kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), value.cast("double").cast("string"))
        .otherwise(text)
    )


def parse_summary(reply: Column) -> Column:
    """Model reply to (summary, key_points, confidence, error).

    ``error`` is set only where a bare JSON scalar makes the field test itself fail; every other
    malformed reply is read as free text.
    """
    return let(parse_json(_strip_fences(reply)), lambda doc: _read_summary(doc, reply))


def _read_summary(doc: Column, reply: Column) -> Column:
    root = F.schema_of_variant(doc)
    kinds = {name: field_type(doc, name) for name in ("summary", "key_points", "confidence")}
    usable = (
        is_object(doc)
        & (kinds["summary"] == "STRING")
        & F.startswith(kinds["key_points"], F.lit("ARRAY"))
        & (_is_number(kinds["confidence"]) | (kinds["confidence"] == "BOOLEAN"))
    )
    points = F.transform(
        F.filter(
            F.try_variant_get(doc, "$.key_points", "array<variant>"),
            lambda x: F.coalesce(
                ~F.to_json(x).isin('""', "0", "0.0", "-0.0", "false", "null", "[]", "{}"), F.lit(False)
            ),
        ),
        _point_text,
    )
    confidence = F.least(F.greatest(field(doc, "confidence", "double"), F.lit(0.0)), F.lit(1.0))
    parsed = _summary(field(doc, "summary", "string"), points, confidence)

    whole = doc.cast("string")
    holds_all = F.lit(True)
    for name in kinds:
        holds_all = holds_all & F.when(root == "STRING", whole.contains(name)).otherwise(
            F.array_contains(F.try_variant_get(doc, "$", "array<string>"), name)
        )
    # What a failed field test or look-up says.
    complaint = (
        F.when(root == "BOOLEAN", "argument of type 'bool' is not iterable")
        .when(root == "BIGINT", "argument of type 'int' is not iterable")
        .when(_is_number(root), "argument of type 'float' is not iterable")
        .when(root == "VOID", "argument of type 'NoneType' is not iterable")
        .when((root == "STRING") & holds_all, "string indices must be integers, not 'str'")
        .when(F.startswith(root, F.lit("ARRAY")) & holds_all, "list indices must be integers or slices, not str")
    )
    nothing = _summary(F.lit(None), F.lit(None), F.lit(None), complaint)
    return (
        F.when(F.coalesce(usable, F.lit(False)), parsed)
        .when(complaint.isNotNull(), nothing)
        .otherwise(summary_from_text(reply))
    )
