"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of the E8 lattice.

Equal vectors are one class from the start. Each class is projected by several random orthonormal maps to eight
dimensions, scaled to the distance that two vectors at the threshold have, and decoded to the nearest lattice point;
that cell is its home, and it also probes the cells of the next nearest lattice points. Keys of cells travel first and
without vectors: cells in which nothing meets drop out, so that a vector is sent only where it has company. Homes of a
cell are compared with each other and with its probes in numpy, in double precision. A pair that links is counted in
the first of the cells where it meets (by table, then key) and in no other; what links is reduced to a spanning forest
within the task, and components come from those forests.

A cell of more than ``tile`` members is dealt into blocks by hash, so that any two members meet in exactly one block of
the cell and no task holds a group. No step makes a row for a pair. With the default scale, probes and tables a pair at
cosine 0.98 meets nowhere with a probability of some 5e-5; closer pairs with less.

Defined results: vectors compare only within an equal, non-null label and length; vectors that are null, empty, zero or
hold null or non-finite components link with nothing; rows that repeat an id are separate rows; a null id never names
a component unless it is alone; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.shared import cut
from rankloom.llm.simhash import Forest

THRESHOLD, TABLES, PROBES, SCALE, TILE, SEED = 0.98, 5, 3, 2.0, 256, 8
#: A block is told by its cell, its place there, and whether its homes are compared with each other (kind 1).
BLOCK = ("key", "i", "j", "kind")


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight halves with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            rows.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    rows += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


def decode_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: round, and where the sum is odd round the worst entry the other way."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = y[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    at = np.arange(len(odd))
    near[odd, worst] += np.where(gap[at, worst] >= 0, 1.0, -1.0)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of the even integer points and their shift by one half."""
    a, b = decode_even(y), decode_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def product_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q, summed in one order: a row has the same product to the last bit in whatever batch it is, which a library's
    product of matrices doesn't promise. A point on the border of a cell is so always found on the same side."""
    out = x[:, :1] * q[0]
    for k in range(1, len(q)):
        out += x[:, k, None] * q[k]
    return out


def probed(y: np.ndarray, home: np.ndarray, probes: int, around: np.ndarray) -> np.ndarray:
    """The ``probes`` neighbours of the home cell whose points are nearest, by rows."""
    gap = y - home  # |home + v - y|^2 = |gap|^2 - 2 gap.v + 2 for every minimal v
    nearest = np.argpartition(-product_of(gap, around.T), probes - 1, axis=1)[:, :probes]
    return home[:, None, :] + around[nearest]


def cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit key of a salt (what must agree besides) and a lattice point. Two cells under one key only cost time."""
    key = salt.astype(np.uint64)
    for column in (2 * points).astype(np.int64).T:
        key = (key ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(vecs: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length: their places, and themselves as rows of unit length."""
    ends = vecs.offsets.to_numpy()
    values, dims = vecs.values.to_numpy(), np.diff(ends)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, unit_rows(values[ends[at][:, None] + np.arange(dim)])


class Lattice:
    """The cells of unit vectors: a key for each home and each probe, in every table."""

    def __init__(self, threshold: float, tables: int, probes: int, scale: float, seed: int):
        self.tables, self.probes, self.seed = tables, probes, seed
        self.width, self.around = scale * np.sqrt(2 - 2 * threshold), minimal_vectors()
        self.maps: dict[int, list[np.ndarray]] = {}

    def keys(self, x: np.ndarray, labels: np.ndarray, probes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table: home keys by row, and probe keys by probe and row (without ``probes`` none)."""
        dim = x.shape[1]
        if dim not in self.maps:
            rng, wide = np.random.default_rng([self.seed, dim]), max(dim, 8)
            self.maps[dim] = [np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dim] / (self.width * np.sqrt(8 / wide)) for _ in range(self.tables)]
        for t, q in enumerate(self.maps[dim]):
            y = product_of(x, q)
            home = decode(y)
            salt = (labels.astype(np.int64) * 1000003 + dim) * 64 + t
            near = probed(y, home, self.probes, self.around) if probes else np.zeros((len(x), 0, 8))
            yield cell_keys(home, salt), np.array([cell_keys(near[:, p], salt) for p in range(near.shape[1])]).reshape(-1, len(x))


def entries(classes: DataFrame, lattice: Lattice, home: bool) -> DataFrame:
    """key and cls of every class in every table: of its home cell, or of the cells that it probes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x in by_length(batch.column(2)):
                for homes, probes in lattice.keys(x, labels[at], probes=not home):
                    keys = homes if home else probes.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(cls[at], len(keys) // len(at)))], names=["key", "cls"])

    return classes.select("cls", "label", "vec").mapInArrow(of, "key long, cls long")


def met(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """key, cls, home, and the numbers of homes and probes of the key, for cells in which a home has company."""
    homes = entries(classes, lattice, True)
    homes_of = homes.groupBy("key").agg(F.count("*").alias("homes"))
    probes = cut(entries(classes, lattice, False).join(homes_of.select("key"), "key"), "probes-met")
    probes_of = probes.groupBy("key").agg(F.count("*").alias("probes"))
    live = cut(homes_of.join(probes_of, "key", "left").select("key", "homes", F.coalesce("probes", F.lit(0).cast("long")).alias("probes")).where("homes + probes > 1"), "cells-met")
    every = [rows.join(live, "key").select("key", "cls", F.lit(home).alias("home"), "homes", "probes") for rows, home in ((homes, True), (probes, False))]
    return every[0].unionByName(every[1])


def dealt(rows: DataFrame, tile: int) -> DataFrame:
    """``BLOCK``, side and cls: rows (key, cls, home, homes, probes) dealt into blocks in which every home meets every
    home and every probe of its key exactly once.

    Where kind is 1 the homes of a block (side 0) are to be compared with each other; with those of side 1 always.
    """
    crowded = (F.col("homes") > tile) | (F.col("probes") > tile)
    rows = rows.withColumns({"_h": F.ceil(F.col("homes") / tile).cast("int"), "_q": F.ceil(F.col("probes") / tile).cast("int"), "_at": F.xxhash64("cls")})
    place = lambda i, j, kind, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    zero = F.lit(0)
    mine, probe = F.pmod("_at", "_h").cast("int"), F.pmod("_at", F.greatest("_q", F.lit(1))).cast("int")
    upto = lambda n: F.sequence(zero, n - 1)
    home_places = F.concat(
        F.array(place(mine, mine, 1, 0)),
        F.transform(F.filter(upto(F.col("_h")), lambda k: k > mine), lambda k: place(mine, k, 2, 0)),
        F.transform(F.filter(upto(F.col("_h")), lambda k: k < mine), lambda k: place(k, mine, 2, 1)),
        F.when(F.col("_q") > 0, F.transform(upto(F.col("_q")), lambda k: place(mine, k, 3, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,kind:int,side:int>>")),
    )
    probe_places = F.transform(upto(F.col("_h")), lambda k: place(k, probe, 3, 1))
    alone = F.array(F.when(F.col("home"), place(zero, zero, 1, 0)).otherwise(place(zero, zero, 1, 1)))
    spread = rows.withColumn("of", F.explode(F.when(~crowded, alone).when(F.col("home"), home_places).otherwise(probe_places)))
    return spread.select("key", "of.i", "of.j", "of.kind", "of.side", "cls")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole blocks out of sorted rows, with the place where each block begins."""
    carried: list[pa.RecordBatch] = []

    def begins(rows: pa.Table) -> np.ndarray:
        ids = [rows[c].to_numpy() for c in BLOCK]
        return np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1))

    for batch in batches:
        rows = pa.Table.from_batches([*carried, batch]).combine_chunks()
        at = begins(rows)
        carried = rows.slice(at[-1]).to_batches()
        if at[-1]:
            yield rows.slice(0, at[-1]).combine_chunks(), at[:-1]
    if carried:
        rows = pa.Table.from_batches(carried).combine_chunks()
        yield rows, begins(rows)


def close_pairs(x: np.ndarray, begins: np.ndarray, own: np.ndarray, side: np.ndarray, threshold: float, dense: int = 48, most: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that reach the threshold. Rows are sorted by block, homes first; large blocks are multiplied
    as matrices, of small ones the pairs of many are taken at once."""
    ends = np.append(begins[1:], len(x))
    sizes = ends - begins
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(sizes > dense).tolist():
        lo, hi = begins[k], ends[k]
        homes = int((side[lo:hi] == 0).sum())
        near = x[lo : lo + homes] @ x[lo:hi].T >= threshold
        near[:, :homes] = np.triu(near[:, :homes], 1) if own[k] else False
        i, j = np.nonzero(near)
        found.append((i + lo, j + lo))
    block = np.repeat(np.arange(len(begins)), sizes)
    first_other = begins + np.bincount(block, weights=side == 0, minlength=len(begins)).astype(np.int64)
    home = np.flatnonzero((side == 0) & (sizes[block] <= dense))
    start = np.where(own[block[home]], home + 1, first_other[block[home]])
    many = ends[block[home]] - start
    upto = np.cumsum(many)
    at = 0
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        n = many[at:to]
        i = np.repeat(home[at:to], n)
        j = np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        found.append((i[near], j[near]))
        at = to
    return tuple(np.concatenate(ends) if found else np.zeros(0, dtype=np.int64) for ends in (list(zip(*found)) or [(), ()]))


def first_meeting(lattice: Lattice, x: np.ndarray, labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The key of the first cell where each pair meets: by table, and within a table the smaller key."""
    rows, of = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = of[: len(i)], of[len(i) :]
    top = np.iinfo(np.int64).max
    out = np.full(len(i), top)
    for homes, probes in lattice.keys(x[rows], labels[rows]):
        open_ = np.flatnonzero(out == top)
        if not len(open_):
            break
        p, q = a[open_], b[open_]
        mine = np.where((homes[p] == homes[q]) | (probes[:, q] == homes[p]).any(axis=0), homes[p], top)
        out[open_] = np.minimum(mine, np.where((probes[:, p] == homes[q]).any(axis=0), homes[q], top))
    return out


def low_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the lowest that it is joined with by the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def find_links(classes: DataFrame, lattice: Lattice, threshold: float, tile: int) -> DataFrame:
    """a, b and n, written: edges between classes that join all that link (n null), and for a class its links as they
    were found (b null, n copies in other classes)."""
    placed = dealt(met(classes, lattice), tile).join(classes.select("cls", "label", "n", "vec"), "cls")
    sorted_rows = placed.select(*BLOCK, "side", "cls", "label", "n", "vec").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counted = Forest(), [np.zeros((2, 0), dtype=np.int64)]

        def told() -> Iterator[pa.RecordBatch]:
            cls, links = np.concatenate(counted, axis=1)
            names, of = np.unique(cls, return_inverse=True)
            sums = np.zeros(len(names), dtype=np.int64)
            np.add.at(sums, of, links)
            counted[:] = counted[:1]
            edges = forest.edges()
            yield pa.RecordBatch.from_arrays([edges.column(0), edges.column(1), pa.nulls(len(edges), pa.int64())], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(sums)], names=["a", "b", "n"])

        for rows, begins in whole_blocks(batches):
            key, kind, side, cls, labels, n = (rows[c].to_numpy() for c in ("key", "kind", "side", "cls", "label", "n"))
            block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            for at, x in by_length(rows["vec"].combine_chunks()):  # lengths differ in a block only where two cells share a key
                starts = np.flatnonzero(np.diff(block[at], prepend=-1))
                i, j = close_pairs(x, starts, kind[at][starts] == 1, side[at], threshold)
                if not len(i):
                    continue
                label = low_labels(len(at), i, j)
                joined = np.flatnonzero(label != np.arange(len(at)))
                forest.join(cls[at][joined], cls[at][label[joined]])
                here = first_meeting(lattice, x, labels[at], i, j) == key[at][i]
                p, q = at[i[here]], at[j[here]]
                links = np.zeros(len(rows), dtype=np.int64)
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                some = np.flatnonzero(links)
                counted.append(np.stack((cls[some], links[some])))
            if len(forest.parent) > 500_000 or sum(c.shape[1] for c in counted) > 1_000_000:
                yield from told()
        yield from told()

    return cut(sorted_rows.mapInArrow(compare, "a long, b long, n long"), "vector-links")


def usable(vector: Column, label: Column) -> Column:
    """Whether the vector can link: labelled, with finite components that aren't all zero."""
    least, most = F.array_min(vector), F.array_max(vector)  # not a number is above all numbers
    finite = (least > -float("inf")) & (most < float("inf")) & ~F.exists(vector, lambda x: x.isNull())
    return F.coalesce(label.isNotNull() & finite & ((least != 0) | (most != 0)), F.lit(False))


def deduplicate(
    rows: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, tile: int = TILE, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the smallest vec_id reachable), kept (it is that one).

    Vectors of floats stay floats on their way, others become doubles; cosines are always of doubles.
    """
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast(kind).alias("vec"))
    rows = rows.withColumn("fine", usable(F.col("vec"), F.col("label")))
    # Two hashes of different seeds, 128 bits, stand for the vector where rows meet their class again.
    names = ["h1", "h2", "label"]
    fine = rows.where("fine").select("vec_id", "label", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(seed), "vec").alias("h2"))
    classes = fine.groupBy(*names, "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    found = find_links(classes, Lattice(threshold, tables, probes, scale, seed), threshold, tile)
    comps = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("cls"), "component")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    named = classes.select("cls", *names, "first_id", "n").join(comps, "cls", "left").join(links, "cls", "left")
    named = cut(named.select(*names, "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "vector-components")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = cut(named.join(lowest, "component").select(*names, "n_links", "component_id"), "vector-results")
    linked = fine.select("vec_id", *names).join(of_class, names).select("vec_id", "n_links", "component_id")
    others = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
