"""The prefix trie against a dictionary of all prefixes, for bucket sizes from one turn up."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm.prefix_trie import end_digests, multikey_sort, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, cls string, bucket long, seq int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest(), (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    seqs = own
    if rebuild:
        seqs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            seqs[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = {}

    def visit(path):
        below = [visit(k) for k in kids[path]]
        saved = (len(members[path]) - 1) * (len(WORD.findall(path[-1][1])) if path else 0) + sum(s for s, _ in below)
        leaves = sum(n for _, n in below) or 1
        ends = ",".join(map(str, sorted(c for c in members[path] if len(seqs[c]) == len(path))))
        c = min(members[path])
        out[c, len(path)] = (min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return saved, leaves

    if members:
        visit(())
    return out


def shown(found):
    rows = [tuple(r) for r in found.collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, seed):
    rng = random.Random(seed)
    texts = [f"{'word ' * k}é x {k}" for k in range(5)]
    rows = []
    for c in range(n):
        c = c * 3 if seed % 2 else c
        long = c % 50 == 0
        for turn in range(rng.randrange(1, 14 if long else 6)):
            rows.append((c, turn, rng.choice(["user", None]) if turn % 2 else "user", rng.choice(texts[: 2 + turn % 4]) if rng.random() < 0.9 else None))
    for c in range(n, n + 30):  # copies, over a long run that many share
        rows += [(c * 3 if seed % 2 else c, turn, "system", f"shared {turn}") for turn in range(12 + c % 3)]
    rng.shuffle(rows)
    return [(*r, 1, "x", 2, 3) for r in rows]


@pytest.mark.parametrize("seed,local,rebuild", [(0, 10**6, True), (1, 25, True), (2, 1, True), (4, 25, False)])
def test_matches_brute_force(spark, seed, local, rebuild):
    rows = made(60, seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert shown(prefix_trie(frame, rebuild, local)) == brute(rows, rebuild)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody's"), (0, None, None, None), (0, 1, "user", "b  c"), (0, 1, "a", "b"), (0, 1, "a", "b"), (1, 5, "user", "x" * 200_000), (2, 0, "user", ""), (25, 0, "u", "t"), (27, 0, "u", "t"), (-3, 0, "u", "t"), (3, 2, None, "z"), (3, None, "q", "z")]
    rows = [(*r, 1, "x", 2, 3) for r in rows]
    for local in (1, 1000):
        assert shown(prefix_trie(spark.createDataFrame(rows, SCHEMA), True, local)) == brute(rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ends_are_streamed_in_pieces(spark):
    ids = list(range(-7, 400))
    seqs = spark.createDataFrame([(c, [(1, 2)]) for c in ids] + [(1000, [])], "conv_id long, seq array<struct<id:long,words:long>>")
    classed = spark.createDataFrame([(-7, len(ids), [(1, 2)]), (1000, 1, [])], "cls long, convs long, seq array<struct<id:long,words:long>>")
    got = {r.cls: r.ends_sha256 for r in end_digests(seqs, classed, piece=9).collect()}
    assert got == {-7: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 1000: hashlib.sha256(b"1000").hexdigest()}


def test_a_chain_of_many_turns_needs_no_recursion():
    n = 5000
    ids = np.concatenate((np.arange(n), np.arange(n - 1), [7])).astype(np.int64)
    got = multikey_sort(ids, np.ones_like(ids), np.array([0, n]), np.array([n, n]), np.array([4, 3]), np.array([1, 2]), 0)
    assert len(got.depth) == n + 2 and got.conv[0] == 3 and got.convs[-1] in (1, 2) and sum(e is not None for e in got.ends) == 2
