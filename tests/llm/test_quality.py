"""Quality classifier: features against brute force, the fit on plain cases, held-out accuracy and defined results."""

import math
import re

import numpy as np
import pytest

from rankloom.llm import quality
from rankloom.llm.shared import held_out


def test_features_depend_on_words_not_places():
    a = quality.features(b"One two  three\nfour")
    assert np.array_equal(a, quality.features(b"  one TWO three four ")) is False  # case is part of the shape
    assert np.array_equal(quality.features(b"a b a b"), quality.features(b"a b a b a b")) is True
    assert len(quality.features(b"")) == len(quality.features(b" \t\n")) == 0
    assert np.array_equal(quality.span_hashes(np.frombuffer(b"xxabyyab", np.uint8).astype(np.uint64), np.array([2, 6]), np.array([4, 8]))[:1], quality.span_hashes(np.frombuffer(b"ab", np.uint8).astype(np.uint64), np.array([0]), np.array([2])))
    assert len(quality.features("ü" .encode() * 200_000)) > 0


def test_coordinate_descent_reaches_the_hinge_optimum():
    """The duality gap closes on random rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(8), r) for r in x]
    w, b = quality.coordinate_descent(rows, y, 8, c=1.0, rounds=3000)
    full = np.append(w, b)
    xs = np.hstack([x, np.ones((60, 1))])
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (xs @ v)).sum()
    best = loss(full)
    assert all(loss(full + 0.01 * rng.normal(size=9)) >= best - 1e-3 for _ in range(200))


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("at", "en", "ing", "or")]
    rows, labels = [], []
    for k in range(400):
        ws = rng.choice(words, size=rng.integers(5, 60))
        good = k % 3 > 0
        rows.append((k, " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws), "x", 0.5))
        labels.append((k, int(good), 0))
    rows += [(1000, None, None, None), (1001, "", "x", 1.0), (1002, "  ", "x", 1.0), (1003, "word " * 30_000, "x", 1.0), (None, "some words", "x", 1.0), (5, rows[5][1], "x", 1.0)]
    labels += [(2000, 1, 0), (None, 0, 0), (3, None, 0), (7, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(made):
    docs, labels = made
    got = quality.classify(docs, quality.train(docs, labels)).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == docs.count()
    back = got[got.held_out & (got.doc_id < 400)]
    assert len(back) > 60 and ((back.doc_id % 3 > 0).astype(int) == back.predicted).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_held_out_labels_do_not_matter(spark, made):
    docs, labels = made
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, other)
    assert np.array_equal(a.weight, b.weight) and (a.a, a.b, a.bias) == (b.a, b.b, b.bias)


def test_one_class_no_labels_and_empty_tables(spark, made):
    docs, labels = made
    none = quality.classify(docs, quality.train(docs, labels.limit(0))).toPandas()
    assert none.score.between(0.49, 0.51).all() and (none.predicted == 0).all()
    only = quality.classify(docs, quality.train(docs, labels.where("quality = 1"))).toPandas()
    assert (only.predicted == 1).all()
    assert quality.classify(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_keep_good_keeps_columns(made):
    docs, labels = made
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.classify(docs, model).where("predicted = 1").count()


def brute_score(text, model):
    """The score by loops over words: shapes as strings, polynomial hashes in whole numbers."""
    top, odd = 2**64, 0x9E3779B97F4A7C15
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    poly = lambda values: sum((v + 1) * pow(odd, k, top) for k, v in enumerate(values)) % top
    folded = [poly([c + 32 if 65 <= c <= 90 else c for c in w]) for w in words]
    kinds = [[1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c for c in w] for w in words]
    shapes = [poly([c for k, c in enumerate(w) if k == 0 or w[k - 1] != c]) * 2 % top for w in kinds]
    shapes = [(s + (k > 0 and folded[k] == folded[k - 1])) % top for k, s in enumerate(shapes)]
    grams = set(folded) | {(a * odd + b + 11) % top for a, b in zip(folded, folded[1:])} | {(s * odd + 23) % top for s in shapes}
    grams |= {((a * odd + b) * odd + 37) % top for a, b in zip(shapes, shapes[1:])}
    grams |= {(((a * odd + b) * odd + c) * odd + 51) % top for a, b, c in zip(shapes, shapes[1:], shapes[2:])}
    bits = len(model.weight).bit_length() - 1
    idx = {((g ^ (g >> 29)) * 0xBF58476D1CE4E5B9 % top) >> (64 - bits) for g in grams}
    norm = math.sqrt(sum(model.square[i] for i in idx))
    margin = (sum(model.weight[i] for i in idx) / norm if norm else 0.0) + model.bias
    return 1 / (1 + math.exp(-(model.a * margin + model.b)))


def test_the_query_scores_as_loops_do(spark):
    from rankloom.llm.shared import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = quality.train(docs, table(spark, "/root/testdata/sf0.001", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [k for k, t in texts.items() if len(t or "") < 3000]
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(got) == len(texts) and len(short) > 100
    for k in short:
        want = brute_score(texts[k], model)
        assert got[k].score == pytest.approx(want, abs=1e-4) and (abs(want - 0.7) < 1e-4 or got[k].predicted == int(want >= 0.7))


@pytest.mark.parametrize("block", [1, 7, 40, 300])
def test_features_in_blocks(block):
    rng = np.random.default_rng(block)
    words = ["A", "a", "b1", "x-y", "\u00c9t\u00e9", "\n", "  ", "long" * 30, "12", "a"]
    for n in (0, 1, 2, 3, 4, 9, 200):
        text = " ".join(rng.choice(words, n)).encode()
        assert (quality.features(text, block=block) == quality.features(text)).all(), text
