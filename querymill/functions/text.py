"""Text rules as column expressions; everything here stays inside whole-stage codegen."""

from pyspark.sql import Column, functions as F

from querymill.defaults import MAX_CONTENT_LENGTH, MAX_QUERY_LENGTH, MAX_RESULTS

# Fixed value: the characters a Unicode-aware regex counts as white space, spelled out so that
# Java and RE2 agree on them. \p{Z} rather than its members: one test instead of eight per character.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
# Fixed value: letters, digits, underscore, blank and the punctuation kept in page text.
KEPT = r"\p{L}\p{N}_ .,!?;:()\-'" + '"'
MIN_LINE = 10


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (SQL trim only knows the blank)."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_query(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, rf"[{SPACE}]+", " "))


def query_hash(normalized: Column) -> Column:
    return F.sha2(F.encode(strip(F.lower(normalized)), "UTF-8"), 256)


def is_valid_request(col: Column) -> Column:
    return F.coalesce(
        F.length(col).between(1, MAX_QUERY_LENGTH) & (F.length(strip(col)) > 0), F.lit(False)
    )


def is_valid_max_results(col: Column) -> Column:
    """A number of results from 1 to 20, or none given."""
    return col.isNull() | col.between(1, MAX_RESULTS)


def clean_text(col: Column) -> Column:
    """One line of kept characters; a result of at most ten characters counts as noise."""
    line = F.trim(
        F.regexp_replace(F.regexp_replace(col, rf"[{SPACE}]+", " "), f"[^{KEPT}]+", " ")
    )
    # As a pattern rather than a CASE, so that the line is worked out once.
    return F.regexp_replace(line, rf"(?s)\A.{{0,{MIN_LINE}}}\z", "")


def truncate(col: Column, limit: int = MAX_CONTENT_LENGTH) -> Column:
    """The first ``limit`` characters and ``...`` if there are more; ``col`` is worked out once."""
    return F.regexp_replace(col, rf"(?s)\A(.{{{limit}}}).+\z", "$1...")


def word_count(col: Column) -> Column:
    return F.size(F.array_remove(F.split(col, f"[{SPACE}]+"), ""))


def split_sentences(col: Column, first: int | None = None) -> Column:
    """All sentences, or the ``first`` few without cutting up the rest of the text."""
    return F.split(col, r"\. ", -1) if first is None else F.slice(F.split(col, r"\. ", first + 1), 1, first)


def document_text(query: Column, summary: Column) -> Column:
    """The text searched by history: query, then the summary if there is one."""
    return F.concat_ws(" | ", query, F.nullif(summary, F.lit("")))


def page_title(given: Column, extracted: Column, url: Column) -> Column:
    """The link's title, else the page's own title element, else the address."""
    return F.coalesce(F.nullif(given, F.lit("")), extracted, url)


def prompt_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def iso_timestamp(col: Column) -> Column:
    """ISO-8601 text as a naive date-time prints itself: microseconds only when there are any."""
    return F.when(
        F.date_format(col, "SSSSSS") == "000000", F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def parse_iso(col: Column) -> Column:
    return F.try_to_timestamp(col)


def bytes_to_mb(col: Column) -> Column:
    return col / (1024 * 1024)
