"""Documents to packed training sequences: toxic texts go, failing and outlying texts go, one of each group of near copies stays, the rest is packed."""

from pyspark.sql import DataFrame, SparkSession

from querymill.llm import jaccard_join, packing, quality_rules, toxicity
from querymill.llm.queries import byte_bpe, table
from querymill.session import Scratch

ORACLE_SQL = None  # learned weights and iterated estimates have no SQL form; see tests/llm


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels does not call toxic."""
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and lie within the cut-off of their language and source."""
    judged = quality_rules.judge(Scratch(spark), quality_rules.with_statistics(docs))
    return judged.where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 connect, the one with the smallest id."""
    return jaccard_join.one_of_each(Scratch(spark), docs, jaccard_join.Rule(words=5, percent=80))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(Scratch(spark), docs.select("doc_id", "text"), byte_bpe())


STAGES = [("toxicity", without_toxic), ("quality rules", of_quality), ("n-gram Jaccard join", one_of_each), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each reads what the one before has written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.cut(docs)
    return docs
