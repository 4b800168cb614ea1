"""Document fingerprints by winnowing, in DataFrame functions.

Hashes of K units in a row are rolled up by doubling. Of every WINDOW hashes in a row the smallest is kept, the rightmost of equal ones, with its
position. Two texts that share WINDOW + K - 1 units in a row share a fingerprint, and nothing shorter than K is matched.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from querymill.session import Scratch

K = 4  # units of a gram; a power of two
WINDOW = 8  # grams of a window
# A unit is a piece of at most three letters or digits, counted from the start of its word, or one sign. White space only parts units.
UNITS = r"[\p{L}\p{N}\p{M}]{1,3}|[^\p{L}\p{N}\p{M}\s]"
LAST = (1 << 31) - 1
NO_ID = -(1 << 63)  # stands for a null id, which comes before all others; no document may have it


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with an array ``name`` of the fingerprints of the column ``text``: hash (31 bits) in the upper half of a long, LAST minus position in the lower.

    A text of fewer than K units is one gram; one without any, and a null, has no fingerprints.
    """
    a, b = f"{name} a", f"{name} b"
    df = df.withColumn(a, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?U)" + UNITS), F.lit(0)), lambda u: F.xxhash64(u)))
    df = df.withColumn(b, F.size(a))
    rolled, run = F.col(a), 1
    while run < K:
        rolled = F.zip_with(rolled, F.slice(rolled, run + 1, F.greatest(F.col(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))
        df = df.withColumn(a, rolled)
        rolled, run = F.col(a), run * 2
    # Grams that run over the end are cut off; a short text keeps its first, which holds it all.
    grams = F.slice(a, 1, F.when(F.col(b) == 0, 0).otherwise(F.greatest(F.col(b) - (K - 1), F.lit(1))))
    df = df.withColumn(a, F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR((F.lit(LAST) - i).cast("long"))))
    df = df.withColumn(b, F.size(a))
    run = 1
    while run < WINDOW:
        step = min(run, WINDOW - run)
        least = F.zip_with(a, F.slice(a, step + 1, F.greatest(F.col(b), F.lit(1))), lambda x, y: F.least(x, y))
        df = df.withColumn(a, least)
        run += step
    whole = F.slice(a, 1, F.when(F.col(b) == 0, 0).otherwise(F.greatest(F.col(b) - (WINDOW - 1), F.lit(1))))
    return df.withColumn(name, F.array_distinct(whole)).drop(a, b)


def hashes(fingerprint: str | Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("int")))


def written(fingerprint: str | Column) -> Column:
    """``hash:position`` in hexadecimal and decimal, in order of position."""
    one = lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit(":"), (F.lit(LAST) - x.bitwiseAND(LAST)).cast("string"))
    return F.array_join(F.transform(fingerprint, one), " ")


def likeness(x: str, y: str) -> Column:
    """Jaccard similarity of two sets of hashes; of two empty ones 1."""
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def next_ids(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next larger id, after the largest the smallest; ids are not null.

    Ids are dealt out by range; within a range neighbours are next to each other, and the first id of each later range, one row
    for each partition, closes the gaps.
    """
    ids = docs.select("doc_id").distinct()
    dealt = scratch.cut(ids.repartitionByRange(ids.sparkSession.sparkContext.defaultParallelism * 4, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("after"))
    return inside.join(after, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compare_edited(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, and how like they are.

    Edited: the last floor(n_chars / 4) code points give way to as many (or all) from the start of the next document, by ascending doc_id, after the
    last the first. A null id comes first; of several texts with the next id the smallest counts; a null text is empty; a single document is followed by itself. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    follows = next_ids(scratch, texts)
    longest = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    wanted = longest.join(follows, "doc_id")
    wanted = scratch.cut(wanted.select(F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), F.floor(F.col("n") / 4).cast("int").alias("m")))
    # What each document hands to the one before it: the start of its text, and its own hashes.
    given = texts.join(wanted, "doc_id").select("of", F.substr("text", F.lit(1), "m").alias("start"), "text")
    given = with_fingerprint(given, "text", "marks").select("of", F.struct("start", hashes("marks").alias("marks")).alias("next"))
    given = given.groupBy(F.col("of").alias("doc_id")).agg(F.min("next").alias("next"))
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    both = texts.join(given, "doc_id").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", n.cast("long").alias("n_chars"), "next",
        F.concat(F.substr("text", F.lit(1), kept), F.substr("next.start", F.lit(1), n - kept)).alias("edited"),
    )
    both = with_fingerprint(both, "text", "own").select("doc_id", "n_chars", "edited", "next", "own")
    both = with_fingerprint(both, "edited", "other").withColumns({"a": hashes("own"), "b": hashes("other"), "c": F.col("next.marks")})
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("own").alias("fingerprint"), written("other").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
