"""Fingerprints and classes against a brute-force version on small rows."""

import re

import numpy as np
import pytest
import xxhash

from rankloom.llm import simhash
from rankloom.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]
    while True:
        new = [min(l for l, g in zip(label, fps) if (f ^ g).bit_count() <= 3) for f in fps]
        if new == label:
            return {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, label)}
        label = new


TEXTS = ["", None, " \t\n", "one", "One two", "a b c", "A B C", "a b c d", "été à la plage", "x" * 5000, "w " * 700, "nbsp stays one word here"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    for base in range(12):
        text = rng.choice(words, size=300).tolist()
        for _ in range(4):
            changed = list(text)
            changed[rng.integers(300)] = "other"
            rows.append((len(rows), " ".join(changed)))
    rows += [(1000, rows[20][1]), (1001, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == brute_classes(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_dense_and_sparse_blocks_join_alike():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    a = np.unique(base ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)))
    b = np.unique(base ^ (np.uint64(3) << rng.integers(0, 62, 60).astype(np.uint64)))

    def roots(pairs):
        forest = simhash.Forest()
        for x, y in pairs:
            forest.join(x.view(np.int64), y.view(np.int64))
        return {n: forest.root(n) for n in list(forest.parent)}

    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
    assert len(i) > len(a) + len(b)
    assert roots([simhash.block_forest(a, b, 3, False)]) == roots([(a[i], b[j])])
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    assert roots([simhash.block_forest(a, a, 3, True)]) == roots([(a[i], a[j])])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


@pytest.mark.parametrize("block", [1, 3, 10, 64])
def test_fingerprint_in_blocks(block):
    rng = np.random.default_rng(block)
    for text in [*TEXTS, "  ".join(rng.choice(["a", "Bc", "déf", "\n", "x" * 50], 200))]:
        assert simhash.fingerprint((text or "").encode(), block=block) == brute_fingerprint(text)


def test_pairs_of_a_crowded_cell_are_spread(spark):
    """5,000 fingerprints of one cell in tiles of 16: every pair of tiles once, and no tile with more than its share."""
    crowd = spark.createDataFrame([(4 * 32 + 9, 313), (4 * 32 + 10, 2)], "cell int, parts long")
    pairs = simhash.tile_pairs(crowd, 3)
    assert pairs.count() == 313 * 314 // 2 + 3 + 313 * 2
    busiest = pairs.groupBy("home", "home_part").count().agg({"count": "max"}).first()[0]
    assert busiest <= 313 + 2 and pairs.distinct().count() == pairs.count()
    rng = np.random.default_rng(3)
    halves = [int(sum(1 << int(b) for b in rng.permutation(16)[:8])) for _ in range(5000)]
    fps = [(int(np.uint64(h << 48 | 0xFF00FF00FF).view(np.int64)) if h < 1 << 15 else (h << 48 | 0xFF00FF00FF) - (1 << 64),) for h in halves]
    got = {(min(r), max(r)) for r in map(tuple, simhash.links(spark.createDataFrame(fps, "fp long"), tile=16).collect())}
    whole = {(min(r), max(r)) for r in map(tuple, simhash.links(spark.createDataFrame(fps, "fp long"), tile=100_000).collect())}
    label = lambda edges: len(components(spark.createDataFrame(list(edges), "a long, b long")).select("component").distinct().collect())
    assert label(got) == label(whole)
