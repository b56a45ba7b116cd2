"""Lines that many documents share are dropped everywhere but in one document, told by keep bitmaps instead of texts.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case; keys of at least ``least``
code points count. Their 128-bit hashes are range-partitioned, and sorted within partitions by document (largest
first) and position. One pass over each sorted partition streams the first occurrences: a key's first document keeps
its lines, and once the key has been met in ``min_docs`` documents all its other lines are dropped. Ranges are cut by
hash and document, so that a line that very many documents hold is spread over several partitions; rows of a key that
may begin in another partition are handed on as open, with a summary for each edge of a partition, and decided by a
join with the summed edges (two rows a partition). Texts take no part in any of this: they meet the bitmaps once, at
the end, where they are wanted (``apply_bitmaps``).

Memory: a task holds one Arrow batch, and of a key's rows those of fewer than ``min_docs`` documents.

Defined results: a null text counts as empty, which is one empty line; rows with the same id are one document, and
repeated rows share their bitmap; a null id counts as the smallest long; texts and lines of any length are hashed
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import cut

LEAST, MIN_DOCS = 40, 5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DROP, OPEN, EDGE = 0, 1, 2
LINE = "hi long, lo long, doc long, row long, pos long"


def document(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))


def body(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc, row (a hash of the text), n_lines and the keys that count: hash in two halves and position from 0."""
    from xxhash import xxh3_128_digest

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, places, hashes = [], [0], [], []
            for text in batch.column(2).cast(pa.binary()):
                lines = text.as_py().translate(LOWER).split(b"\n")
                counts.append(len(lines))
                for k, line in enumerate(lines):
                    if len(line) >= least:
                        key = line.strip()  # of bytes: just the six ASCII white-space bytes
                        if len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least):
                            places.append(k)
                            hashes.append(xxh3_128_digest(key))
                ends.append(len(places))
            halves = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            keys = pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(places, pa.int64())], names=["hi", "lo", "pos"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], names=["doc", "row", "n_lines", "keys"])

    rows = docs.select(document(id_col).alias("doc"), F.xxhash64(body(text_col)).alias("row"), body(text_col).alias("text"))
    return rows.mapInArrow(of, "doc long, row long, n_lines long, keys array<struct<hi:long,lo:long,pos:long>>")


class Stream:
    """The pass over one sorted partition. ``feed`` takes a batch and ``close`` ends it; both give rows with a kind."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple[int, int] | None = None  # the key of the last row
        self.first = True  # whether that key is the partition's first
        self.seen = 0  # its documents among rows that have gone out
        self.top = self.last = 0  # its first document, and the last one that went out
        self.held = np.empty((0, 5), np.int64)  # its rows while its documents are too few

    @staticmethod
    def told(kind: int, rows: np.ndarray) -> np.ndarray:
        return np.column_stack((np.full(len(rows), kind, np.int64), rows))

    def edge(self, docs: int) -> np.ndarray:
        return np.array([[EDGE, *self.key, self.top, 0, docs]], np.int64)

    def feed(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        if not len(rows):
            return
        rows = np.concatenate((self.held, rows))
        goes_on = self.seen > 0 and (int(rows[0, 0]), int(rows[0, 1])) == self.key
        if self.key and not goes_on and self.first and self.seen:
            yield self.edge(self.seen)
            self.first = False
        new_key = np.ones(len(rows), bool)
        new_key[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        new_doc = new_key.copy()
        new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
        if goes_on:
            new_doc[0] = rows[0, 2] != self.last
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, len(rows)))
        total = np.cumsum(new_doc)
        base = total[starts] - 1  # documents in the batch before each key
        if goes_on:
            base[0] = -self.seen
        nth = total - np.repeat(base, sizes)
        ends = starts + sizes - 1
        docs = nth[ends]
        keep_open = np.zeros(len(starts), bool)
        opening = self.key is None or (self.first and goes_on)
        keep_open[0] = opening
        enough = np.repeat((docs >= self.min_docs) & ~keep_open, sizes)
        yield self.told(DROP, rows[enough & (nth > 1)])
        if opening:
            yield self.told(OPEN, rows[: sizes[0]])
        lone = len(starts) == 1
        if opening and not lone:
            self.key, self.top = (int(rows[0, 0]), int(rows[0, 1])), self.top if goes_on else int(rows[0, 2])
            yield self.edge(int(docs[0]))
        at = starts[-1]
        if not (lone and goes_on):
            self.top = int(rows[at, 2])
        self.key, self.first = (int(rows[at, 0]), int(rows[at, 1])), opening and lone
        if self.first or docs[-1] >= self.min_docs:
            self.held, self.seen, self.last = rows[:0], int(docs[-1]), int(rows[-1, 2])
        else:
            self.held, self.seen = rows[at:], 0

    def close(self) -> Iterator[np.ndarray]:
        if self.key:
            yield self.told(OPEN, self.held)
            yield self.edge(self.seen or len(np.unique(self.held[:, 2])))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row and pos of every line that goes. ``lines`` has the columns of ``LINE``; pos is a line's place in its row."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state = ["kind", "hi", "lo", "doc", "row", "pos"], Stream(min_docs)
        tell = lambda found: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names=names)
        for batch in batches:
            yield from map(tell, state.feed(np.column_stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.empty((0, 5), np.int64)))
        yield from map(tell, state.close())

    by = [F.col("hi"), F.col("lo"), F.desc("doc")]
    ordered = lines.select("hi", "lo", "doc", "row", "pos").repartitionByRange(*by).sortWithinPartitions(*by, "row", "pos")
    told = cut(ordered.mapInArrow(stream, f"kind long, {LINE}"), "line-stream")
    edges = told.where(F.col("kind") == EDGE).groupBy("hi", "lo").agg(F.sum("pos").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    late = told.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["hi", "lo"]).where("doc <> top")  # edges: two rows a partition
    return told.where(F.col("kind") == DROP).select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each id and text: doc, row, n_lines, n_dropped and keep, a deflated bitmap of the lines that stay
    (most significant bit first), null where all do."""
    keys = cut(line_keys(docs, id_col, text_col, least), "line-keys")
    gone = dropped_lines(keys.select("doc", "row", F.explode("keys").alias("key")).select("key.hi", "key.lo", "doc", "row", "key.pos"), min_docs)
    places = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))  # lines of one document

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for n, lost in zip(batch.column(2).to_pylist(), batch.column(3)):
                where = lost.values.to_numpy() if lost.is_valid else ()
                bits = np.ones(n, np.uint8)
                bits[list(where)] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1) if len(where) else None)
                counts.append(len(where))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "row", "n_lines", "n_dropped", "keep"])

    every = keys.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines")).join(places, ["doc", "row"], "left")
    return every.mapInArrow(pack, "doc long, row long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of ``docs``."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).cast(pa.binary())
            kept = []
            for text, keep, n in zip(texts, batch.column(3), batch.column(1).to_pylist()):
                text = text.as_py()
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=n)
                    lines = text.split(b"\n")
                    text = b"\n".join([lines[k] for k in np.flatnonzero(bits)])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), document(id_col).alias("doc"), F.xxhash64(body(text_col)).alias("row"), body(text_col).alias("text"))
    met = rows.join(bitmaps, ["doc", "row"]).select("doc_id", "n_lines", "n_dropped", "keep", "text")
    return met.mapInArrow(thin, "doc_id long, n_lines long, n_dropped long, kept_text string")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row."""
    return apply_bitmaps(docs, cut(line_bitmaps(docs, id_col, text_col, least, min_docs), "line-bitmaps"), id_col, text_col)
