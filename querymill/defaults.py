"""Default limits and thresholds. Every one of them is an argument where it is used."""

# They decide results and must not drift.
SIMILARITY_THRESHOLD = 0.85
JUDGE_THRESHOLD = 0.8
MAX_CANDIDATES = 5
MAX_SOURCES = 5
MAX_CONTAINERS = 10
MIN_CONTENT_LENGTH = 100
MAX_CONTENT_LENGTH = 10_000
MAX_PROMPT_SOURCE_LENGTH = 2_000
EXTRACTIVE_SOURCES = 3
MAX_QUERY_LENGTH = 500
MAX_RESULTS = 20
HISTORY_LIMIT = 10
