"""Building prompts and summaries from a query and its ordered array of scraped pages."""

from pyspark.sql import Column, functions as F

from querymill.defaults import EXTRACTIVE_SOURCES, MAX_PROMPT_SOURCE_LENGTH, MIN_CONTENT_LENGTH
from querymill.functions.replies import let, parse_summary
from querymill.functions.text import prompt_title, split_sentences, strip, truncate, word_count
from querymill.schemas import SUMMARY

# Wording that ends up in results.
EMPTY_TEXT = (
    "I was unable to find sufficient information to answer your query: '",
    "'. The web scraping encountered issues with the available sources. "
    "This could be due to website restrictions, network issues, or the content not being accessible.",
)
EMPTY_POINTS = [
    "No sufficient content was found for this query",
    "Web scraping may have encountered technical issues",
    "Consider rephrasing your query or trying again later",
    "Some websites may block automated access",
]
ERROR_TEXT = (
    "An error occurred while processing your query: '",
    "'. The system was able to retrieve content from ",
    " sources, but encountered an issue during summarization. Error: ",
)
ERROR_POINTS = [
    "Content was successfully retrieved from web sources",
    "Summarization process encountered an error",
    "The AI service may be temporarily unavailable",
    "Raw content was obtained but not processed",
    "Please try again later or contact support",
]
EXTRACTIVE_POINTS = ["Content retrieved from web search", "Summary created without AI processing"]
PROMPT_CLOSING = (
    "Base your response on the provided content and follow the JSON format specified in the system prompt."
)
EXTRACTIVE_CONFIDENCE = 0.3


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def good_pages(pages: Column) -> Column:
    return F.filter(pages, lambda p: p["success"])


def meaningful_pages(pages: Column, least: int = MIN_CONTENT_LENGTH) -> Column:
    return F.filter(pages, lambda p: p["success"] & (F.length(p["content"]) >= least))


def _urls(pages: Column) -> Column:
    return F.transform(pages, lambda p: p["url"])


def _summary(text, points, sources, confidence, as_of) -> Column:
    record = lambda summary: F.struct(
        summary.alias("summary"),
        points.alias("key_points"),
        sources.alias("sources"),
        confidence.cast("double").alias("confidence"),
        word_count(summary).alias("word_count"),
        F.lit("en").alias("language"),
        as_of.cast("timestamp").alias("generated_at"),
    )
    return let(text, record).cast(SUMMARY)


def empty_summary(query: Column, pages: Column, as_of: Column) -> Column:
    failed = _urls(F.filter(pages, lambda p: ~p["success"]))
    text = F.concat(F.lit(EMPTY_TEXT[0]), query, F.lit(EMPTY_TEXT[1]))
    return _summary(text, _texts(EMPTY_POINTS), failed, F.lit(0.0), as_of)


def error_summary(query: Column, pages: Column, error: Column, as_of: Column) -> Column:
    sources = _urls(good_pages(pages))
    text = F.concat(
        F.lit(ERROR_TEXT[0]), query, F.lit(ERROR_TEXT[1]), F.size(sources).cast("string"), F.lit(ERROR_TEXT[2]), error
    )
    return _summary(text, _texts(ERROR_POINTS), sources, F.lit(0.0), as_of)


def lead_sentence(content: Column) -> Column:
    """First of the first two sentences longer than 50 characters, null if neither is."""
    first = F.filter(
        F.transform(split_sentences(content, 2), strip), lambda s: F.length(s) > 50
    )
    return F.concat(F.get(first, F.lit(0)), F.lit("."))


def key_sentence(content: Column) -> Column:
    """First of the first five sentences between 30 and 150 characters, null if none is."""
    first = F.filter(
        F.transform(split_sentences(content, 5), strip),
        lambda s: (F.length(s) > 30) & (F.length(s) < 150),
    )
    return F.get(first, F.lit(0))


def extractive_summary(query: Column, pages: Column, as_of: Column) -> Column:
    """Leads and key sentences of the first good pages; no model involved."""
    def built(good: Column) -> Column:
        used = F.slice(good, 1, EXTRACTIVE_SOURCES)
        leads = F.array_join(F.transform(used, lambda p: lead_sentence(p["content"])), " ")
        points = F.array_compact(F.transform(used, lambda p: key_sentence(p["content"])))
        count = F.size(good).cast("string")
        stock = F.concat(
            F.array(F.concat(F.lit("Found information from "), count, F.lit(" sources"))), _texts(EXTRACTIVE_POINTS)
        )
        text = let(
            leads,
            lambda found: F.when(
                found != "", F.concat(F.lit("Based on the available sources for '"), query, F.lit("': "), found)
            ).otherwise(F.concat(F.lit("Information found about '"), query, F.lit("' from "), count, F.lit(" sources."))),
        )
        chosen = let(points, lambda found: F.when(F.size(found) > 0, found).otherwise(stock))
        summary = _summary(text, chosen, _urls(good), F.lit(EXTRACTIVE_CONFIDENCE), as_of)
        return F.when(F.size(good) > 0, summary).otherwise(empty_summary(query, pages, as_of))

    return let(good_pages(pages), built)


def build_prompt(query: Column, pages: Column) -> Column:
    """User prompt: the query, numbered and truncated sources, the request."""
    def source(page, i):
        heading = F.concat(
            F.lit("\n--- Source "), (i + 1).cast("string"), F.lit(": "), prompt_title(page["title"]),
            F.lit(" ("), page["url"], F.lit(") ---"),
        )
        return F.concat_ws("\n", heading, truncate(page["content"], MAX_PROMPT_SOURCE_LENGTH), F.lit(""))

    head = F.array(F.concat(F.lit("User Query: "), query), F.lit(""), F.lit("Content from multiple web sources:"))
    tail = F.array(
        F.concat(
            F.lit("\nPlease create a comprehensive summary that directly answers the query: '"), query, F.lit("'")
        ),
        F.lit(PROMPT_CLOSING),
    )
    return F.array_join(F.concat(head, F.transform(pages, source), tail), "\n")


def model_summary(query: Column, pages: Column, reply: Column, error: Column, as_of: Column) -> Column:
    """Summary where a model is set up: needs meaningful pages, an answer, and a readable one."""
    def routed(parsed: Column) -> Column:
        failed = F.coalesce(error, parsed["error"])
        return (
            F.when(F.size(meaningful) == 0, empty_summary(query, pages, as_of))
            .when(failed.isNotNull(), error_summary(query, pages, failed, as_of))
            .otherwise(
                _summary(parsed["summary"], parsed["key_points"], _urls(meaningful), parsed["confidence"], as_of)
            )
        )

    meaningful = meaningful_pages(pages)
    return let(parse_summary(reply), routed)
