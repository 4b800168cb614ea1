"""The registered queries of this package, over whole tables, and SQL where it can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from querymill.llm import (
    bpe_fold, chat_format, hard_negatives, jaccard_join, packing, piece_bpe, quality_rules, token_counts, toxicity, turn_trie, url_filters, warc, winnowing,
)
from querymill.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> packing.Tokenizer:
    at = public_tokenizers.path
    return packing.Tokenizer(at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, table(spark, sf_dir, "labels"), without=["text"]).select("doc_id", "held_out", "score", "predicted")


@query()
def op7_quality_rules(spark, sf_dir):
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = scratch.cut(quality_rules.with_statistics(docs, without=["text"]))
    return quality_rules.judge(scratch, stats).select("doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


@query()
def op2_jaccard_join(spark, sf_dir):
    """The component of every text; texts without words are alone, equal ones together, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rule = jaccard_join.Rule(words=4, percent=85)
    return jaccard_join.classes(Scratch(spark), docs, rule).select("doc_id", "n_shingles", "component_id")


@query()
def op6_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(Scratch(spark), docs, byte_bpe())


RULES = [
    url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "example.org", "/es/"), url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"), url_filters.Rule("block", "com", "/de/"),
]


@query()
def op1_url_filters(spark, sf_dir):
    """A page's URL carries the number of the document it shows; that document's quality labels the URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract(url_filters.path(F.col("url")), "/([0-9]{1,18})(?![0-9])", 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("shown"), F.when(F.col("quality") == 0, "block").otherwise("allow").alias("label"))
    labelled = pages.select("url", shown.alias("shown")).join(labels, "shown").select("url", "label")
    judged = url_filters.judge(Scratch(spark), pages, labelled, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def _written(text: str) -> str:
    """Length of a text with its control strings escaped, in SQL."""
    marks = f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
    return f"(2 * length({text}) - length(replace({text}, chr(92), '')) + (length({text}) - length(replace({text}, '</turn>', ''))) // 7 + {marks})"


SAID = "chr(92) || '### Assistant: </turn> ok'"
TURNS = f"""
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {SAID} UNION ALL SELECT -7, 1, 'assistant', {SAID})"""


@query(f"""WITH {TURNS},
    told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(14 + {_written('role')} + length(role) - length(replace(role, ':', '')) + {_written('text')})::BIGINT AS formatted_chars FROM said GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told""")
def op4_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.read_back(chat_format.examples(turns.unionByName(added)))


@query()
def op5_winnowing(spark, sf_dir):
    return winnowing.compare_edited(Scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM d""")
def op8_warc(spark, sf_dir):
    records = warc.archive_and_read(Scratch(spark), table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), without=["text"])


@query()
def op10_bpe_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_fold.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op11_piece_bpe(spark, sf_dir):
    """Ids of every whole text, hashed, and of the text that they decode to; null and empty texts have none, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = piece_bpe.decode(piece_bpe.encode(docs, path, without=["text"]), path)
    hashed = [F.sha2(c, 256).alias(n) for c, n in ((F.array_join("ids", ","), "ids_sha256"), (F.col("decoded"), "decoded_sha256"))]
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *hashed, "agrees")


# CRC-32 of a number's decimal digits, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@query(f"""WITH t AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said.role, md5(length(said.role)::VARCHAR || ':' || said.role || ':' || said.text)) AS turns FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, turns, {CRC} % 4 AS h FROM o),
    r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, d, turns[1:d] AS first, d = len(turns) AS ended FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
    n AS (SELECT first, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
      CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(first[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM p GROUP BY first, d),
    k AS (SELECT first[1:d - 1] AS first, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
    c AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (d, first)),
    s AS (SELECT first[1:e] AS first, e AS d, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM c, unnest(range(0, d + 1)) AS u(e) GROUP BY ALL)
    SELECT c.conv_id, c.d AS depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
    FROM c JOIN s USING (d, first) LEFT JOIN n q ON q.d = c.d - 1 AND q.first = c.first[1:c.d - 1]""")
def op12_turn_trie(spark, sf_dir):
    """Each conversation begins with up to three turns of the first one of its twenty; rows without conv_id take no part, turns of one number go by role and id."""
    scratch, conv = Scratch(spark), F.col("conv_id")
    convs = turn_trie.sequences(table(spark, sf_dir, "conversations"))
    rebuilt = turn_trie.with_starts_of(scratch, convs, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return turn_trie.trie(scratch, rebuilt)


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id, score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id,
      p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10""")
def op13_hard_negatives(spark, sf_dir):
    """Every seventh row gets the next label, so that some near rows are negatives; rows without a label or a sound vector take no part."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(Scratch(spark), rows.select("vec_id", "embedding", moved.alias("label")))


@query()
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
