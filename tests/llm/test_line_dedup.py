"""Line dedup against a loop over all lines, over many partitions, and on odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm.line_dedup import DROP, EDGE, OPEN, Stream, apply_bitmaps, deduplicate_lines, line_bitmaps

SCHEMA = "doc_id long, text string, doc long, row string, keep string, n_lines int"
WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least=40, min_docs=5):
    low = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least:
                holders[key_of(line)].add(low(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key_of(x), ())) >= min_docs and max(holders[key_of(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def shown(found):
    return sorted(map(tuple, found.collect()), key=repr)


def made(n, seed):
    rng = random.Random(seed)
    shared = [f"  {'Passage of many documents ' * 2}{k} \t" for k in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"a line of its own that is long enough to count {i} {rng.random()}" for _ in range(rng.randrange(1, 9))]
        lines += [shared[0].upper()] * (rng.random() < 0.9) + [""] * (rng.random() < 0.3) + ["short"] * (rng.random() < 0.5)
        rows.append((i, "\n".join(lines), None, None, None, None))
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_matches_brute_force(spark, parts):
    rows = made(120, parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert shown(deduplicate_lines(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    a, wide = "é" * 40, "ß" * 39
    rows = [(k, f"{a}\n{wide}\n{a} \n\nx", k, "r", "k", 1) for k in range(6)] + [(6, None, None, None, None, None), (7, "", 0, "", "", 0), (None, a, 0, "", "", 0), (None, f"{a}\n", 0, "", "", 0)]
    rows += [(3, f"{a}\n{wide}\n{a} \n\nx", 3, "r", "k", 1), (5, f"another text\n{a}", 5, "", "", 0), (8, "q" * 200_000 + "\n" + "w\n" * 50_000, 0, "", "", 0)]
    assert shown(deduplicate_lines(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)
    assert deduplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_names_and_bounds(spark):
    rows = [(k, "abc\nABC \nd") for k in range(3)]
    frame = spark.createDataFrame(rows, "`the id` long, `a text` string")
    assert shown(deduplicate_lines(frame, "the id", "a text", least=3, min_docs=3)) == brute(rows, 3, 3)


def test_bitmaps_are_of_documents_and_hold_no_text(spark):
    rows = made(40, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    maps = line_bitmaps(frame)
    assert maps.columns == ["doc", "row", "n_lines", "n_dropped", "keep"] and maps.count() == 40
    assert maps.where("(n_dropped = 0) <> (keep IS NULL)").count() == 0
    assert shown(apply_bitmaps(frame, maps)) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_stream_over_any_cuts(seed):
    """However sorted rows are cut into partitions and batches, drops and edges tell the same lines."""
    rng = np.random.default_rng(seed)
    rows = sorted({(int(h), 7, int(d), 0, int(p)) for h, d, p in zip(rng.integers(0, 9, 300), rng.integers(0, 12, 300), rng.integers(0, 3, 300))}, key=lambda r: (r[0], -r[2], r[4]))
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(9)}
    want = {r for r in rows if len(docs[r[0]]) >= 5 and r[2] != max(docs[r[0]])}
    cuts = sorted({0, len(rows), *[k for k in rng.integers(1, len(rows), 5).tolist() if rows[k][:3] != rows[k - 1][:3]]})
    told = []
    for lo, hi in zip(cuts, cuts[1:]):
        state, at = Stream(5), lo
        while at < hi:
            step = int(rng.integers(0, 40))
            told += [r for found in state.feed(np.array(rows[at : min(at + step, hi)], np.int64).reshape(-1, 5)) for r in found.tolist()]
            at += step
        told += [r for found in state.close() for r in found.tolist()]
    edges = defaultdict(lambda: [0, -1])
    for r in told:
        if r[0] == EDGE:
            edges[r[1]] = [edges[r[1]][0] + r[5], max(edges[r[1]][1], r[3])]
    got = [tuple(r[1:]) for r in told if r[0] == DROP] + [tuple(r[1:]) for r in told if r[0] == OPEN and edges[r[1]][0] >= 5 and r[3] != edges[r[1]][1]]
    assert len(got) == len(set(got)) and set(got) == want
