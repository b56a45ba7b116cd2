"""SimHash near-duplicates by exact tiled comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters. Fingerprints that
differ in at most ``radius`` bits have quarter counts that differ by at most ``radius`` in sum, so tile pairs beyond
that are never made; what is left is compared whole with numpy's exclusive-or and bit counts. A tile holds some 512
fingerprints at most: a crowded cell is dealt into several by hash, and any two of them meet in one task's row. Tile
pairs are listed by their keys first and fetch their two tiles by cell and part, so that the pairs of a crowded cell are
spread over all its parts. A tile pair yields a spanning forest of its links and never the links themselves, so a large group of near copies
costs comparisons but no rows.

A text is hashed in blocks of ``BLOCK`` bytes that overlap by a shingle, so that memory doesn't grow with its length by
more than the text itself.

Defined results: ties don't occur, as every fingerprint within the radius is a link; a null text counts as empty and gets fingerprint zero, which links like any other; repeated rows
share their class; a null id never names a class unless it is alone in it; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.shared import KEY, cut, keep_rows, row_key

SHINGLE, SEED, RADIUS, TILE, BLOCK = 3, 42, 3, 512, 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, block: int) -> Iterator[list[bytes]]:
    """The words of a text, in lists for some ``block`` bytes each."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + block)
        end = gap.start() if gap else len(text)
        if words := text[at:end].translate(LOWER).split():  # bytes.split() cuts at just the six ASCII white-space bytes
            yield words
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> int:
    """The 64-bit fingerprint of one text: a bit is set if it is set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest

    counts, total, last = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(text, block):
        words = last + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
            hashes = np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
            for part in range(0, len(hashes), 200):  # sums of up to 200 ones fit a byte, which numpy adds fastest
                counts += np.add.reduce(np.unpackbits(hashes[part : part + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            total += len(hashes)
            words = words[len(words) - shingle + 1 :]
        last = words
    if not total:
        return xxh64_intdigest(b" ".join(last), seed) if last else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and ``KEY`` (what tells rows apart) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", KEY])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), row_key(F.col(f"`{id_col}`"), text).alias(KEY))
    return rows.mapInArrow(of, f"doc_id long, fp long, {KEY} string")


def cell_code(fp: Column) -> Column:
    """The population counts of the four quarters, five bits each, moved up by four so that neighbours never carry."""
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(0xFFFF)) for q in range(4)]
    return sum(((q + 4) * (32**k) for k, q in enumerate(quarters)), F.lit(0))


def half_neighbours(radius: int) -> list[int]:
    """Code differences of cells within the radius, one of each opposite pair, and zero."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [sum(x * 32**k for k, x in enumerate(d)) for d in steps]


def block_forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links between ``a`` and ``b`` that join whatever all links within the radius join."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) < len(a) + len(b):
        return a[i], b[j]
    # Many links: spread the smallest label over the block until it rests, then tie each member to its label's owner.
    of_a, of_b = np.arange(len(a)), np.arange(len(b)) + len(a)
    while True:
        new_b = np.minimum(of_b, np.where(near, of_a[:, None], len(a) + len(b)).min(axis=0))
        new_a = np.minimum(of_a, np.where(near, new_b[None, :], len(a) + len(b)).min(axis=1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == of_a).all() and (new_b == of_b).all():
            break
        of_a, of_b = new_a, new_b
    every = np.concatenate((a, b))
    label = np.concatenate((of_a, of_b))
    return every, every[label]


class Forest:
    """Union-find over the links that one task has met; gives back one link per member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = x = p[up]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if (rx := self.root(x)) != (ry := self.root(y)):
                self.parent[max(rx, ry)] = min(rx, ry)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        self.parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())})


def tile_pairs(crowd: DataFrame, radius: int) -> DataFrame:
    """home, home_part, cell and part of every pair of tiles to compare, once each. ``crowd`` is (cell, parts): a row for
    each cell that has fingerprints."""
    crowd = cut(crowd, "cells")
    steps = F.explode(F.array(*map(F.lit, half_neighbours(radius))))
    near = crowd.select(F.col("cell").alias("home"), F.col("parts").alias("home_parts"), steps.alias("step")).withColumn("cell", F.col("home") + F.col("step")).join(crowd, "cell")
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = near.withColumn("home_part", parts("home_parts")).withColumn("part", parts("parts"))
    return every.where("home <> cell OR home_part <= part").select("home", "home_part", "cell", "part")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints that join all those within the radius. ``fps`` has a column fp."""
    distinct = cut(fps.select("fp").distinct().withColumn("cell", cell_code(F.col("fp"))), "fingerprints")
    crowd = distinct.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = cut(
        distinct.join(crowd, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")).agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    pairs = tile_pairs(distinct.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts")), radius)
    home = tiles.select(F.col("cell").alias("home"), F.col("part").alias("home_part"), F.col("fps").alias("home_fps"))
    pairs = pairs.join(home, ["home", "home_part"]).join(tiles, ["cell", "part"])
    pairs = pairs.select("home_fps", "fps", ((F.col("home") == F.col("cell")) & (F.col("home_part") == F.col("part"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            ends = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1))]
            for k, same in enumerate(batch.column(2).to_pylist()):
                a, b = (values[at[k] : at[k + 1]] for values, at in ends)
                x, y = block_forest(a, b, radius, same)
                if len(x):
                    forest.join(x.view(np.int64), y.view(np.int64))
            if len(forest.parent) > 500_000:
                yield forest.edges()
        yield forest.edges()

    return pairs.mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    return _classed(docs, id_col, text_col, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classed(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    fps = cut(fingerprints(docs, id_col, text_col), "doc-fingerprints")
    of_fp = components(links(fps, radius)).select(F.col("node").alias("fp"), "component")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = cut(first.join(of_fp, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "named")
    lowest = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    of_fp = cut(named.join(lowest, "component").select("fp", "component", "component_id"), "classes")
    return fps.join(of_fp, "fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each class of near copies, that of the smallest id, with all its columns."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", KEY))
    kept = _classed(docs, id_col, text_col, radius).groupBy("component").agg(best.alias("best")).select(F.col(f"best.{KEY}").alias(KEY))
    return keep_rows(docs, kept, id_col, text_col)
