"""Cross-entropy difference against a dictionary-based brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import lm_score as lm

SCHEMA = "doc_id long, text string, score string, n_tokens long"
ROWS = [(0, "Abba abab.", "x", 1), (1, "cab cab", "x", 1), (2, None, None, None), (3, "", "x", 0), (4, "aé日\U0001f600b" * 30, "x", 1), (5, "ab " * 40_000, "x", 1), (None, "bca", "x", 1), (1, "cab cab", "x", 1)]
SYMBOLS, ORDER, PRIOR = 6, 3, 4.0


def brute(rows, target_ids):
    """Losses by nested dictionaries of tuples."""
    chars = Counter(c for _, t, *_ in rows for c in (t or "").lower() if ord(c) < 0x3000)
    vocab = [c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2]]
    syms = lambda t: ["<e>"] * (ORDER - 1) + [c if c in vocab else "<u>" for c in (t or "").lower()] + ["<e>"]
    grams = lambda t: [tuple(s[i - ORDER + 1 : i + 1]) for s in [syms(t)] for i in range(ORDER - 1, len(s))]
    counts = [Counter(g for i, t, *_ in rows if i in target_ids for g in grams(t)), Counter(g for _, t, *_ in rows for g in grams(t))]
    scale = sum(counts[0].values()) / sum(counts[1].values())
    counts[1] = {g: n * scale for g, n in counts[1].items()}
    suffix = []
    for c in counts:
        by = {}
        for g, n in c.items():
            for k in range(1, ORDER + 1):
                by[g[-k:]] = by.get(g[-k:], 0) + n
                by[g[-k:-1], "any"] = by.get((g[-k:-1], "any"), 0) + n
        suffix.append(by)

    def p(by, g):
        return (by.get(g, 0) + PRIOR * (p(by, g[1:]) if len(g) > 1 else 1 / SYMBOLS)) / (by.get((g[:-1], "any"), 0) + PRIOR)

    out = []
    for i, t, *_ in rows:
        gs = grams(t)
        out.append((i, len(gs), *(-sum(math.log(p(by, g)) for g in gs) / len(gs) for by in suffix)))
    return out


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 1), (1, 0, 0), (None, 1, 0), (77, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    models = lm.train(docs, lm.labelled_good(docs, labels), SYMBOLS, ORDER)
    got = lm.score(docs, models)
    assert got.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    key = lambda r: (r[0] is None, r[0], r[1])
    for have, want in zip(sorted(map(tuple, got.collect()), key=key), sorted(brute(ROWS, {0, 4}), key=key), strict=True):
        assert have[:2] == want[:2] and have[2:4] == pytest.approx(want[2:], rel=1e-5) and have[4] == pytest.approx(want[2] - want[3], abs=1e-5)


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(0).integers(0, 3, 5**3).astype(float)
    p = np.exp(lm.log_probabilities(counts, 5, 3)).reshape(-1, 5)
    assert np.allclose(p.sum(axis=1), 1)


def test_no_target_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = lm.score(docs, lm.train(docs, docs.limit(0), SYMBOLS, ORDER)).collect()
    assert all(r.score == 0 for r in got)
    none = docs.limit(0)
    assert lm.score(none, lm.train(none, none, SYMBOLS, ORDER)).count() == 0


def test_every_script_has_its_own_symbols(spark):
    many = " ".join(chr(c) for c in [*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x450)])
    rows = [(0, "あいう えお" * 20), (1, "さしす せそ" * 20), *[(k, many) for k in range(2, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs, docs.where("doc_id = 0"))).collect()}
    assert got[0].score < 0 < got[1].score
    symbols = len({c for _, t in rows for c in t}) + 2
    capped = {r.doc_id: r for r in lm.score(docs, lm.train(docs, docs.where("doc_id = 0"), symbols)).collect()}
    assert {k: r.score for k, r in got.items()} == {k: pytest.approx(r.score, abs=1e-9) for k, r in capped.items()}


def test_more_symbols_than_numbers_of_ngrams_can_hold():
    text = "".join(chr(c) for c in range(0x20000, 0x20000 + 60_000))  # none has another case, so that no two n-grams are equal
    parts = list(lm.numbered(*lm.tokens([text], 4, None)[:2], 4))
    assert len(parts) == 2 and sum(len(g) for _, g in parts) == 60_001
    assert sum(len(last) for _, last, _ in lm.distinct([text], 4, None)) == 60_001


def test_good_ids_by_broadcast_or_by_merge(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(9)] + [(None, "n"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    want = [(1, "t1"), (3, "again"), (3, "t3")]
    assert sorted(map(tuple, lm.labelled_good(docs, labels).collect())) == want
    monkeypatch.setattr(lm, "BROADCAST_IDS", 1)
    assert sorted(map(tuple, lm.labelled_good(docs, labels).collect())) == want


def test_ids_as_target_match_brute_force_in_pieces_of_any_size(spark, monkeypatch):
    rows = ROWS + [(9, "xyz " * 30, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    ids = spark.createDataFrame([(0,), (4,), (4,), (None,), (77,)], "doc_id int")
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(brute(rows, {0, 4}), key=key)
    for size in (30, 4_000_000):
        monkeypatch.setattr(lm, "PIECE", size)
        got = sorted(map(tuple, lm.score_against(docs, ids, SYMBOLS, ORDER).collect()), key=key)
        for have, need in zip(got, want, strict=True):
            assert have[:2] == need[:2] and have[2:4] == pytest.approx(need[2:], rel=1e-9) and have[4] == pytest.approx(need[2] - need[3], abs=1e-9)


def test_both_ways_to_score_agree(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7} of many" * (k % 5)) for k in range(60)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(60)], "doc_id long, quality int")
    one = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, lm.labelled_good(docs, labels))).collect()}
    two = {r.doc_id: r.score for r in lm.score_against(docs, lm.good_ids(labels)).collect()}
    assert two == {k: pytest.approx(v, abs=1e-12) for k, v in one.items()} and len(two) == 60


def test_ids_as_target_of_nothing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = lm.good_ids(spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in lm.score_against(docs, none).collect()} == {0.0}
    assert lm.score_against(docs.limit(0), none).count() == 0


def test_texts_are_not_shuffled_after_they_are_in_buckets(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    pieces = lm.in_pieces(docs, "doc_id", "text")
    other = spark.range(5).select(F.col("id").alias("piece"), "id")
    plan = pieces.groupBy("piece").cogroup(other.groupBy("piece")).applyInArrow(lambda a, b: a, "doc_id long, text string, piece long")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
