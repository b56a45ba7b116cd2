"""Exact deduplication against a brute-force version, over batches and on odd rows."""

import hashlib
import re
import uuid

from rankloom.llm.exact_dedup import DigestIndex, deduplicate, fresh_index, keep_first
from rankloom.llm.shared import shared_dir

SCHEMA = "doc_id long, text string, digest string, row long"
ROWS = [(1, "a b", "x", 1), (2, "ab ", "x", 1), (3, "a\tb\r\n", "y", 2), (4, None, None, None), (5, "", "z", 0), (6, " \x0b\x0c", "z", 0), (7, "a b", "q", 5), (8, "é" * 9000, "", 1), (None, "solo", "s", 1), (9, "ab ", "x", 1)]


def brute(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = {}
    for i, t, *_ in rows:
        same = [(-len(u or ""), j is None, j or 0) for j, u, *_ in rows if plain(u) == plain(t)]
        best = min(same)
        out[i] = (None if best[1] else best[2], len(same), hashlib.sha256(plain(t).encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    got = deduplicate(spark.createDataFrame(ROWS, SCHEMA).repartition(3), fresh_index(spark)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_ids_keep_one_row(spark):
    got = deduplicate(spark.createDataFrame([(1, "a"), (1, "a"), (1, "a")], "doc_id long, text string"), fresh_index(spark)).collect()
    assert [r.group_size for r in got] == [3, 3, 3] and sum(r.kept for r in got) == 1


def test_later_batches_meet_the_index(spark):
    path = f"{shared_dir(spark)}/index-test-{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "a "), (3, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in deduplicate(first, DigestIndex(spark, path, 4)).where("kept").collect()) == [1, 2]
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(second, DigestIndex(spark, path, 4)).collect()}
    assert got == {0: (1, False), 3: (3, True), 4: (3, False)}
    assert sorted(r.keep_id for r in DigestIndex(spark, path, 4).read().collect()) == [1, 2, 3]


def test_index_is_not_shuffled_for_the_anti_join(spark):
    index = DigestIndex(spark, f"{shared_dir(spark)}/index-plan-{uuid.uuid4().hex}", 4)
    plan = index.read().join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty_table_and_columns_stay(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert deduplicate(empty, fresh_index(spark)).count() == 0
    kept = keep_first(spark.createDataFrame(ROWS, SCHEMA), fresh_index(spark))
    assert kept.columns == ["doc_id", "text", "digest", "row"] and kept.count() == len({v[2] for v in brute(ROWS).values()})


def test_a_batch_that_failed_is_given_again(spark, monkeypatch):
    path = f"{shared_dir(spark)}/index-retry-{uuid.uuid4().hex}"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(0, "a "), (3, "c"), (4, "c"), (5, "d")], "doc_id long, text string")
    deduplicate(old, DigestIndex(spark, path, 4), batch="one").collect()
    want = {0: (1, False), 3: (3, True), 4: (3, False), 5: (5, True)}
    deduplicate(new, DigestIndex(spark, path), batch="two")  # appended, but its result is lost
    for _ in range(2):
        assert {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(new, DigestIndex(spark, path), batch="two").collect()} == want
    assert sorted(r.keep_id for r in DigestIndex(spark, path).read().collect()) == [1, 2, 3, 5]
    assert not any(r.kept for r in deduplicate(new, DigestIndex(spark, path), batch="three").collect())

    # A run that stopped while it appended: half of its digests are in the index.
    part = f"{shared_dir(spark)}/index-part-{uuid.uuid4().hex}"
    deduplicate(new.where("doc_id IN (3, 4)"), DigestIndex(spark, part, 4), batch="two").collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(new, DigestIndex(spark, part), batch="two").collect()}
    assert got == {0: (0, True), 3: (3, True), 4: (3, False), 5: (5, True)} and DigestIndex(spark, part).read().count() == 3


def test_buckets_come_from_the_first_batch_and_drop_leaves_results(spark, monkeypatch):
    from rankloom.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "PER_BUCKET", 2)
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 3)
    index = fresh_index(spark)
    got = deduplicate(spark.createDataFrame([(k, f"t{k}") for k in range(10)], "doc_id long, text string"), index)
    assert index.buckets == 5 and DigestIndex(spark, index.path).buckets == 5
    index.drop()
    assert got.where("kept").count() == 10 and not spark.catalog.tableExists(index.name)


def test_keep_rows_chooses_before_the_shuffle(spark):
    from rankloom.llm.shared import KEY, keep_rows, row_key
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, "same", 1, 2)] * 50 + [(1, "x", 3, 4), (2, "y", None, None)], "doc_id long, text string, row int, nth int")
    kept = docs.where("doc_id IS NULL OR doc_id = 1").select(row_key(F.col("doc_id"), F.col("text")).alias(KEY)).distinct()
    got = keep_rows(docs.repartition(3), kept, "doc_id", "text")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x", 3, 4), (None, "same", 1, 2)] and got.columns == docs.columns
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = keep_rows(docs, kept, "doc_id", "text").select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan and "Partial" in plan
