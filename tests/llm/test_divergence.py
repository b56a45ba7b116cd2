"""The audit of sources against whole-number loops over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import divergence
from rankloom.llm.divergence import Audit, audit, block_sums

SCHEMA = "doc_id long, text string, lang string, source string, term string, k int, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least=3, top=200):
    docs, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, lang, source, *_ in rows:
        found = [lower(t) for t in TERM.findall(text or "")]
        docs[lang or ""].update(set(found))
        groups[lang or ""][source or ""].update(found)
    out = set()
    rate = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, every = len(kept), Counter()
        for counts in sources.values():
            every.update(counts)
        n = {s: sum(c[t] for t in kept) for s, c in sources.items()}
        p = {s: {t: rate(c[t], n[s], v) for t in kept} for s, c in sources.items()}
        q = {t: rate(every[t], sum(n.values()), v) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(sorted(found)[:most], 1)}
    return out


def made(n, seed, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "Über", "été", "x", "日本") for b in "abcdefgh"]
    rows = []
    for i in range(n):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        mine = words[: 5 + 5 * int(source[1:])]
        text = rng.choice([" ", "-", "\x00", "9"]).join(rng.choice(mine) for _ in range(rng.randrange(30)))
        rows.append((i, text, rng.choice(["en", "de", None]), source, None, None, None))
    return rows


@pytest.mark.parametrize("seed,heavy", [(1, 0.0), (2, 0.25), (3, 1.0)])
def test_matches_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(divergence, "MOST", 20)
    rows = made(150, seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in audit(frame, top=6).collect()} == brute(rows, top=6)
    sums = Audit(frame).pair_sums(postings=10, cells=9, heavy=heavy)  # many chunks, blocks of one row
    want = sorted(v for lang, _, part, _, v, _ in brute(rows) if part == "pair" and lang == "en")
    assert sorted(r.value for r in sums.where("lang = 'en'").collect()) == want


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "rare words", "en", "b"), (4, "A a B", "de", "x"), (4, "A a B", "de", "x"), (4, "A a B", "de", "x"), (5, "12 34", "de", "y"), (6, "é" * 100_000 + " É", "de", "z")]
    rows = [(*r, "t", 1, "v") for r in rows]
    got = {tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and ("en", "a", "pair", "b", 0, 1) in got
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_names_and_bounds(spark):
    rows = made(60, 5)
    frame = spark.createDataFrame(rows, SCHEMA).toDF("doc_id", "the text", "a lang", "of", "term", "k", "value")
    assert {tuple(r) for r in audit(frame, "the text", "a lang", "of", least=5, top=2).collect()} == brute(rows, 5, 2)


@pytest.mark.parametrize("seed", range(4))
def test_both_parts_add_up(seed):
    """Any split into heavy and light, any block and tile width, gives the plain sums."""
    rng = np.random.default_rng(seed)
    n, terms = 9, 40
    have = rng.random((terms, n)) < rng.random(terms)[:, None]
    have[np.arange(terms), rng.integers(0, n, terms)] = True
    p0 = rng.integers(1, 50, n)
    p = np.where(have, rng.integers(1, 10**9, (terms, n)), p0)
    want = sum(((p[t][:, None] - p[t][None, :]) ** 2 // p[t][None, :]) for t in range(terms))
    t, i = np.nonzero(have)
    for heavy in (0.0, 0.3, 0.6, 1.0):
        for lo, hi in ((0, n), (2, 5)):
            got = block_sums(t, i, p[t, i], have.sum(axis=1)[t], p0, lo, hi, heavy, cells=20)
            off = np.arange(lo, hi)[:, None] != np.arange(n)
            assert (got == want[lo:hi])[off].all()
