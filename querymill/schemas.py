"""Record types as Spark schemas."""

from pyspark.sql import Column, functions as F, types as T

# The states a query and a scrape may be in.
QUERY_STATUSES = ("valid", "invalid", "pending", "processing", "completed", "failed")
SCRAPE_STATUSES = ("success", "failed", "timeout", "blocked", "error")


_TEXT, _REAL, _INT, _LONG, _FLAG, _TIME = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
)
_TEXTS, _VECTOR = T.ArrayType(_TEXT), T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CLASSIFICATION = _struct(status=_TEXT, confidence=_REAL, reason=_TEXT, suggested_improvements=_TEXTS)
SCRAPED_CONTENT = _struct(
    url=_TEXT, title=_TEXT, content=_TEXT, content_length=_INT, scraped_at=_TIME, success=_FLAG,
    error_message=_TEXT, status=_TEXT,
)
SUMMARY = _struct(
    summary=_TEXT, key_points=_TEXTS, sources=_TEXTS, confidence=_REAL, word_count=_INT, language=_TEXT,
    generated_at=_TIME,
)
QUERIES = _struct(query_id=_LONG, arrival=_LONG, ts=_TIME, query=_TEXT)
SEARCH_RESULTS = _struct(query_id=_LONG, engine=_TEXT, position=_INT, title=_TEXT, url=_TEXT, snippet=_TEXT)
RESULT_STORE = _struct(
    query_hash=_TEXT, query=_TEXT, status=_TEXT, confidence=_REAL, reason=_TEXT,
    scraped_content=T.ArrayType(SCRAPED_CONTENT), summary=SUMMARY, embedding=_VECTOR, created_at=_TIME,
    execution_time=_REAL, pages_scraped=_INT, total_content_length=_LONG, document=_TEXT,
)
# What the store can hand out as one JSON text, and reads back.
STORED_RECORD = _struct(
    query=_TEXT, query_hash=_TEXT, classification=CLASSIFICATION, scraped_content=T.ArrayType(SCRAPED_CONTENT),
    summary=SUMMARY, embedding=_VECTOR, created_at=_TIME, execution_time=_REAL, cache_hit=_FLAG,
)
OUTCOMES = _struct(
    query_id=_LONG, ts=_TIME, query=_TEXT, query_hash=_TEXT, outcome=_TEXT, status=_TEXT, matched_hash=_TEXT,
    similarity_score=_REAL, semantic_similarity=_REAL, semantic_reason=_TEXT, message=_TEXT, error=_TEXT,
)


def scraped_record(url, title, content, success, error_message, scraped_at) -> Column:
    """One scraped page; length and status always follow from content and success."""
    content, success = F.coalesce(content, F.lit("")), F.coalesce(success, F.lit(False))
    return F.struct(
        url.alias("url"),
        title.alias("title"),
        content.alias("content"),
        F.length(content).alias("content_length"),
        scraped_at.cast("timestamp").alias("scraped_at"),
        success.alias("success"),
        error_message.cast("string").alias("error_message"),
        F.when(success, "success").otherwise("failed").alias("status"),
    )


def is_query_status(col: Column) -> Column:
    return col.isin(*QUERY_STATUSES)


def is_scrape_status(col: Column) -> Column:
    return col.isin(*SCRAPE_STATUSES)


def is_confidence(col: Column) -> Column:
    """A number in [0, 1]; NaN and null are not."""
    return F.coalesce(col.between(0.0, 1.0), F.lit(False))
