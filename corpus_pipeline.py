"""A corpus run of five operators: quality, language, exact copies, near copies, packing.

Each stage takes what the one before kept, written as Parquet and read again, and trains or indexes on just that. The
filtering stages return the columns of documents; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import exact_dedup, langid, packing, quality, registry, simhash
from rankloom.llm.shared import cut, table

#: SQL can't express the trained filters and the packing; tests/llm/test_pipeline.py has the brute-force versions.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return langid.keep_known(docs, langid.train(docs))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the longest spelling."""
    index = exact_dedup.fresh_index(spark)
    kept = exact_dedup.keep_first(docs, index)
    index.drop()  # what is kept is told by tables of its own
    return kept


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with a digest of their ids."""
    tokenizer = packing.load_tokenizer(registry.tokenizer_file("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", no_exact_copies),
    ("SimHash near-dedup", no_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
