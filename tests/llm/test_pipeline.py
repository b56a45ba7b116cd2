"""The pipeline stage by stage: each stage's decisions on its own input against a plain version."""

import re

import corpus_pipeline
from rankloom.llm import langid, quality
from tests.llm.test_packing import check_pieces, plain
from tests.llm.test_simhash import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, "12 34 -- 56", "en", "x", 11)], docs.schema)
    docs, columns = docs.unionByName(odd), docs.columns
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            from tokenizers import Tokenizer

            from rankloom.llm.packing import load_tokenizer
            from rankloom.llm.registry import tokenizer_file

            tok = Tokenizer.from_str(load_tokenizer(tokenizer_file("byte_bpe_50k.json")))
            rows = out.collect()
            total = {i: len(plain(tok, r.text)) for i, r in before.items()}
            assert {r.doc_id: r.doc_tokens for r in rows} == total
            assert sum(r.length for r in rows) == sum(total.values())
            assert len({r.sequence_id for r in rows}) <= -(-sum(total.values()) // 1024) + 1
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept_docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r for r in kept_docs.collect()}
        assert kept_docs.count() == len(kept) and all(before[i] == r for i, r in kept.items())
        if name == "quality classifier":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, r in before.items() if model.score((r.text or "").encode()) >= 0.7}
        elif name == "language ID":
            model = langid.train(docs)
            ids = list(before)
            want = {ids[j] for j, lang, *_ in langid.label([before[i].text for i in ids], model) if lang != "und"}
        elif name == "exact dedup":
            groups = {}
            for i, r in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), i))
            want = {min(g)[1] for g in groups.values()}
        else:
            want = {i for i, (_, c) in brute_classes([(i, r.text) for i, r in before.items()]).items() if i == c}
        assert set(kept) == want, name
        docs = kept_docs
    assert len(before) > 50


def test_run_gives_the_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "z y x w"), (None, "q r s t"), (None, "q r s t"), (None, "k l m n")], "doc_id long, text string")
    for stage in (corpus_pipeline.no_exact_copies, corpus_pipeline.no_near_copies):
        assert sorted((r.doc_id or 0, r.text) for r in stage(spark, docs, SF).collect()) == [(0, "k l m n"), (0, "q r s t"), (1, "a b c d"), (1, "z y x w")]


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_clashing_columns_stay_as_they_are(spark):
    names = ["score", "kept", "component_id", "digest", "fp", "row", "_key", "_nth", "label", "of", "held_out"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        if name != "packing":
            rows = out.collect()
            assert out.columns == wide.columns and rows and all(r[n] == n for r in rows for n in names)
            assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, SF).collect()}
