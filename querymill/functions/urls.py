"""Address rules as column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Documents and sites that are never scraped.
SKIPPED_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"]
SKIPPED_DOMAINS = ["facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com"]
# Search page addresses.
SEARCH_TEMPLATES = {
    "a": ("https://html.duckduckgo.com/html/?q=", ""),
    "b": ("https://www.google.com/search?q=", "&hl=en"),
}
REDIRECT_PREFIX = "/url?q="


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_valid_url(url: Column) -> Column:
    """Scheme and authority present, not a document, not a skipped site.

    The tests are as coarse as they look: the extension is tested at the end of the whole
    address and the site name anywhere in the authority.
    """
    cleaned = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]+", "")
    authority = F.lower(F.regexp_extract(cleaned, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))
    lowered = F.lower(url)
    unbalanced = authority.contains("[") != authority.contains("]")
    return F.coalesce(
        (authority != "")
        & ~unbalanced
        & ~_any(F.endswith(lowered, F.lit(e)) for e in SKIPPED_EXTENSIONS)
        & ~_any(authority.contains(d) for d in SKIPPED_DOMAINS),
        F.lit(False),
    )


def url_domain(url: Column) -> Column:
    """Host in lower case without its first ``www.``; what is not an address is returned as it is."""
    text = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    host = r"(\[[^\]/?#\\]*\]|[^:/?#\\]*)"
    web = F.regexp_extract(text, rf"(?i)^(?:https?|ftp|wss?):[/\\]*(?:[^/?#\\]*@)?{host}", 1)
    other = F.regexp_extract(text, rf"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?{host}", 1)
    is_web = text.rlike(r"(?i)^(?:https?|ftp|wss?):")
    is_other = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    bad_host = (web == "") | web.rlike(r"""^[^\[].*[\x00-\x20"%<>^`{|}\[\]]""")
    found = F.lower(F.when(is_web, web).otherwise(other))
    at = F.locate("www.", found)
    bare = F.when(at > 0, F.concat(F.substring(found, F.lit(1), at - 1), F.substring(found, at + 4, F.length(found)))).otherwise(found)
    return F.when((is_web & bad_host) | ~(is_web | is_other), url).otherwise(bare)


def unwrap_redirect(url: Column) -> Column:
    """``/url?q=<target>&…`` to its decoded target; ``+`` and broken escapes stay as they are."""
    target = F.split_part(F.replace(url, F.lit(REDIRECT_PREFIX), F.lit("")), F.lit("&"), F.lit(1))
    safe = F.replace(F.regexp_replace(target, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.startswith(url, F.lit(REDIRECT_PREFIX)), F.try_url_decode(safe)).otherwise(url)


def search_url(query: Column, engine: str) -> Column:
    """Search page address with the query form-encoded into it."""
    head, tail = SEARCH_TEMPLATES[engine]
    encoded = F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(head), encoded, F.lit(tail))
