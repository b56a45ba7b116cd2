"""Columns of names that operators use inside change nothing."""

import pytest
from pyspark.sql import functions as F

from rankloom.llm import divergence, embedding_dedup, line_dedup, lm_score, prefix_trie, quality, sentencepiece_codec, urls
from rankloom.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.001"
NAMES = (
    "key cls home probes vec2 of rule action verdict host path score piece context last t b ids decoded n_tokens row doc hi lo pos keep kind term n docs idx p q k nth "
    "source_ lead head seq bucket up up_conv depth conv at share back learned _h _c _key _row held_out"
).split()


def widened(df):
    return df.select("*", *[F.lit(n).alias(n) for n in NAMES if n not in df.columns])


OPERATORS = {
    "op2": ("embeddings", lambda df: embedding_dedup.deduplicate(df.limit(150))),
    "op5": ("pages", urls.judge),
    "op8": ("documents", lambda df: lm_score.score(df, lm_score.train(df, df.where("doc_id % 3 = 0").select("doc_id", "text"))).select("doc_id", F.round("score", 6))),
    "op10": ("documents", lambda df: sentencepiece_codec.round_trip(df.where("n_chars < 2000"), sentencepiece_codec.load_model(tokenizer_file("piece_bpe_32k.model")))),
    "op11": ("documents", divergence.audit),
    "op12": ("documents", line_dedup.deduplicate_lines),
    "op13": ("conversations", prefix_trie.prefix_trie),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    table, run = OPERATORS[name]
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    plain, wide = run(df), run(widened(df))
    assert plain.columns == wide.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wide.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
