"""Lattice decoding against enumeration, and vectors against all pairs compared."""

from itertools import combinations, product

import numpy as np
import pytest

from rankloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, n long"


def test_decoding_is_nearest():
    rng = np.random.default_rng(0)
    around = ed.minimal_vectors()
    assert len(np.unique(around, axis=0)) == 240 and np.allclose((around**2).sum(axis=1), 2) and (around.sum(axis=1) % 2 == 0).all()
    y = rng.normal(size=(200, 8)) * 3
    home = ed.decode(y)
    assert (np.abs(2 * home - np.rint(2 * home)) < 1e-12).all()
    second = home[:, None, :] + np.concatenate([around, (around[:, None] + around[None]).reshape(-1, 8)])[None]
    best = ((second - y[:, None]) ** 2).sum(axis=2).min(axis=1)
    assert (((home - y) ** 2).sum(axis=1) <= best + 1e-9).all()
    got = ed.probed(y, home, 3, around)
    dist = np.sort(((home[:, None] + around - y[:, None]) ** 2).sum(axis=2), axis=1)[:, :3]
    assert np.allclose(np.sort(((got - y[:, None]) ** 2).sum(axis=2), axis=1), dist)


def brute(rows, threshold=0.98):
    ok = lambda v, label: label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    unit = [np.asarray(np.asarray(v, np.float32), np.float64) if ok(v, label) else None for _, v, label, *_ in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    link = [[a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold for b in range(len(rows))] for a in range(len(rows))]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(rows)), 2):
            if link[a][b] and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    first = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((r[0] if r[0] is not None else -1), sum(link[k]), first[comp[k]], r[0] == first[comp[k]]) for k, r in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for label in (0, 1):
        for size in (1, 2, 3, 40):
            base = rng.normal(size=24)
            base /= np.linalg.norm(base)
            for _ in range(size):
                noise = rng.normal(size=24)
                noise /= np.linalg.norm(noise)
                cos = rng.uniform(0.981, 0.999)
                out.append([*(cos * base + np.sqrt(1 - cos**2) * noise)])
        out += [rng.normal(size=24).tolist() for _ in range(40)]
    made = [(k, [float(np.float32(x)) for x in v], k % 2 if k % 11 == 0 else int(k >= len(out) // 2), "x", 1) for k, v in enumerate(out)]
    v = made[50][1]
    made += [(500, v, made[50][2], "x", 1), (501, v, made[50][2], "x", 1), (501, v, made[50][2], "x", 1), (None, v, made[50][2], None, None), (502, v, None, "x", 1), (503, [2.0 * x for x in v], made[50][2], "x", 1), (504, [-x for x in v], made[50][2], "x", 1)]
    made += [(600, None, 0, "x", 1), (601, [], 0, "x", 1), (602, [0.0] * 24, 0, "x", 1), (603, [None, *v[1:]], 0, "x", 1), (604, [float("nan"), *v[1:]], 0, "x", 1), (605, [float("inf"), *v[1:]], 0, "x", 1), (606, v[:5], 0, "x", 1), (607, v[:5], 0, "x", 1), (608, [-0.0, *v[1:]], 0, "x", 1), (609, [0.0, *v[1:]], 0, "x", 1)]
    return made


@pytest.mark.parametrize("tile", [256, 4])
def test_matches_all_pairs(spark, rows, tile):
    """With small tiles every group is dealt into many blocks."""
    got = ed.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id, r.kept) for r in got.collect()) == brute(rows)


def test_pairs_just_above_the_threshold_are_found():
    """The share of pairs at cosine 0.98 that meet in no table, by the lattice itself."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1)[:, None]
    met = np.zeros(len(x), dtype=bool)
    around = ed.minimal_vectors()
    for _ in range(ed.TABLES):
        q = np.linalg.qr(rng.normal(size=(64, 8)))[0] / (ed.SCALE * 0.2 * np.sqrt(8 / 64))
        a, b = x @ q, y @ q
        ha, hb = ed.decode(a), ed.decode(b)
        pa, pb = ed.probed(a, ha, ed.PROBES, around), ed.probed(b, hb, ed.PROBES, around)
        met |= (ha == hb).all(axis=1) | (pa == hb[:, None]).all(axis=2).any(axis=1) | (pb == ha[:, None]).all(axis=2).any(axis=1)
    assert met.mean() > 0.999


def test_every_two_members_meet_once(spark):
    rows = [(k % 3, k, k % 2 == 0) for k in range(90)]
    homes = {key: sum(h for q, _, h in rows if q == key) for key in range(3)}
    df = spark.createDataFrame([(key, cls, home, homes[key], 30 - homes[key]) for key, cls, home in rows], "key long, cls long, home boolean, homes long, probes long")
    blocks, met = {}, {}
    for r in ed.dealt(df, 5).collect():
        blocks.setdefault((r.key, r.i, r.j, r.kind), ([], []))[r.side].append(r.cls)
    for (*_, kind), (sides, others) in blocks.items():
        assert len(sides) <= 30 and len(others) <= 30
        for pair in [*(combinations(sides, 2) if kind == 1 else []), *product(sides, others)]:
            met[tuple(sorted(pair))] = met.get(tuple(sorted(pair)), 0) + 1
    want = {tuple(sorted(p)): 1 for k in range(3) for p in combinations(range(k, 90, 3), 2) if p[0] % 2 == 0 or p[1] % 2 == 0}
    assert met == want


@pytest.mark.parametrize("dense", [1, 3, 48])
def test_close_pairs_of_blocks(dense):
    """Matrices and pairs give what two loops give, in blocks with and without comparisons among homes."""
    rng = np.random.default_rng(5)
    x = ed.unit_rows(rng.normal(size=(60, 2)))
    begins = np.array([0, 1, 3, 10, 30, 31])
    own = np.array([True, True, False, True, True, False])
    side = np.concatenate([np.sort(rng.integers(0, 2, n)) for n in np.diff(np.append(begins, 60))])
    want = {(i, j) for k, (lo, hi) in enumerate(zip(begins, [*begins[1:], 60])) for i in range(lo, hi) for j in range(lo, hi) if side[i] == 0 and (side[j] == 1 or (own[k] and i < j)) and x[i] @ x[j] >= 0.9}
    i, j = ed.close_pairs(x, begins, own, side, 0.9, dense=dense, most=7)
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_doubles_and_a_long_chain(spark):
    """Vectors on an arc, each within the threshold of its neighbours alone: one component, two links each."""
    angle = np.arange(40) * 0.19
    rows = [(k, [float(np.cos(a)), float(np.sin(a)), 0.0], 1) for k, a in enumerate(angle.tolist()) if a < 6.0]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (1 if k in (0, len(rows) - 1) else 2, 0) for k in range(len(rows))}


def test_empty_table(spark):
    assert ed.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_hang_on_the_row_alone():
    """Whatever the batch, also where points are on the borders of cells."""
    rng = np.random.default_rng(2)
    x = ed.unit_rows(np.round(rng.normal(size=(3000, 48)), 1) + 0.05)
    lattice, labels = ed.Lattice(0.98, 5, 3, 2.0, 8), np.zeros(3000, np.int64)
    every = list(lattice.keys(x, labels))
    for rows in (np.array([7]), np.arange(2), rng.permutation(3000)[:501], np.arange(3000)[::-1]):
        for (homes, probes), (some, others) in zip(every, lattice.keys(x[rows], labels[rows])):
            assert (homes[rows] == some).all() and (probes[:, rows] == others).all()
