"""Cross-entropy difference of matched character n-gram models of a target and of the whole corpus.

Both models have the same vocabulary (every code point that occurs after lower-casing, an unknown and a boundary
symbol), the same order and the same smoothing, and the background counts are scaled to the target's mass, so that a
loss difference never comes from unequal evidence. All counts are of whole texts over all rows: tasks count the n-grams
of runs of texts, Spark adds them up, and the model is a written table with a row for each n-gram of the corpus, which
grows with it. No part of it is fetched but three totals.

Scoring deals the documents into pieces of some ``PIECE`` bytes, in a table bucketed by piece, and takes the different
n-grams of each piece. Their probabilities are joined from the model by n-gram and meet the texts again in their bucket, so
that texts are shuffled once, and what a worker holds is bounded by its piece (or by one longer text), not by the corpus.
Where the corpus that is scored is the background too (``score_against``), the same n-grams of pieces are what is counted:
ids of the target go to the pieces, never texts to ids, which is one plan for a target of any size.

Memory: a worker holds some tens of bytes for each character of a run of texts or of one longer text, however long.

A document's score is its loss per token under the target less that under the background, in nats: below zero is
nearer the target. Defined results: an empty table gives no rows; a null or empty text is the end symbol alone (one token); rows are scored one by
one; without a target both models are the background's and every score is 0; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.shared import cut, run_dir

ORDER, PRIOR, PIECE = 4, 4.0, 4_000_000
#: Pieces to a bucket of their table, some 64 MB, and the buckets of a small table.
PER_BUCKET, LEAST_BUCKETS = 16, 32
#: The most ids that are broadcast: some 100 MB.
BROADCAST_IDS = 5_000_000
#: Symbols are code points, and after them the boundary and the unknown one. A context holds up to three in a long.
EDGE, UNKNOWN, ALL, BITS = 0x110000, 0x110001, 0x110002, 21


def vocabulary(docs: DataFrame, symbols: int, text_col: str = "text") -> np.ndarray:
    """The ``symbols`` - 2 most frequent code points, ties by code point."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALL, dtype=np.int64)
        for texts in runs(batches):
            s, ends, _ = tokens(texts, 1, None)
            counts += np.bincount(s[ends], minlength=ALL)
        at = np.flatnonzero(counts[:EDGE])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["cp", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(of, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return np.array([r.cp for r in counted.orderBy(F.desc("n"), "cp").limit(symbols - 2).collect()], dtype=np.int64)


def runs(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterator[list[str]]:
    """The texts of the first column (null as empty), some ``size`` characters at a time."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(text or "")
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def tokens(texts: list[str], order: int, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts with edges around each, the place of each token (the last of a text is its end), and the
    number of tokens of each text. Code points out of ``kept`` are unknown."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    s = np.frombuffer(("\0" * (order - 1) + ("\0" * order).join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    if kept is not None:
        own = np.zeros(ALL, dtype=bool)
        own[kept] = True
        s[~own[s]] = UNKNOWN
    begins = np.cumsum(sizes + order) - sizes - order
    token = np.ones(len(s), dtype=bool)
    for k in range(order - 1):
        token[begins + k] = False
        s[begins + k] = EDGE
    s[begins + order - 1 + sizes] = EDGE
    return s, np.flatnonzero(token), sizes + 1


def numbered(s: np.ndarray, ends: np.ndarray, order: int, run: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols that occur, and the number over them of the n-gram that ends at each of ``ends``. Where such numbers
    don't fit in 63 bits, there are several parts of ``run`` tokens."""
    present = np.zeros(ALL, dtype=bool)
    present[s] = True
    symbols = np.flatnonzero(present)
    if len(symbols) ** order >= 1 << 63:
        for k in range(0, len(ends), run):
            part = ends[k : k + run]
            first = part[0] - order + 1
            yield from numbered(s[first : part[-1] + 1], part - first, order, run)
        return
    place = np.zeros(ALL, dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    at, n = place[s], len(s) - order + 1
    out = at[:n].copy()
    for k in range(1, order):
        out *= len(symbols)
        out += at[k : n + k]
    yield symbols, out[ends - order + 1]


def distinct(texts: list[str], order: int, kept: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Context, last symbol and count of the n-grams of the texts."""
    for symbols, grams in numbered(*tokens(texts, order, kept)[:2], order):
        found, n = np.unique(grams, return_counts=True)
        yield *spelled(found, symbols, order), n


def spelled(found: np.ndarray, symbols: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and last symbol of n-grams by their numbers."""
    rest, last = np.divmod(found, len(symbols))
    context = np.zeros(len(found), dtype=np.int64)
    for k in range(order - 1):
        rest, at = np.divmod(rest, len(symbols))
        context |= symbols[at] << (BITS * k)
    return context, symbols[last]


def distinct_marked(texts: list[str], marked: np.ndarray, order: int, kept: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Context, last symbol, count in the marked texts and count in all of the n-grams of the texts."""
    s, ends, sizes = tokens(texts, order, kept)
    of, done = np.repeat(marked, sizes).astype(np.uint64), 0
    for symbols, grams in numbered(s, ends, order):
        keys, n = np.unique(grams.astype(np.uint64) * 2 + of[done : done + len(grams)], return_counts=True)
        done += len(grams)
        found = keys >> 1
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        t = np.add.reduceat(np.where(keys & 1, n, 0), first)
        yield *spelled(found[first].astype(np.int64), symbols, order), t, np.add.reduceat(n, first)


def in_batches(columns: list[np.ndarray], names: list[str], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + size], pa.int64()) for c in columns], names=names)


def count_ngrams(docs: DataFrame, kept: np.ndarray | None = None, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """context, last and n over all whole texts; every task sends on one row for each n-gram of a run of texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in runs(batches):
            for found in distinct(texts, order, kept):
                yield from in_batches(list(found), ["context", "last", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(of, "context long, last long, n long")


def log_probabilities(counts: np.ndarray, symbols: int, order: int = ORDER, prior: float = PRIOR) -> np.ndarray:
    """Log of p(token | context) for every n-gram: each order's counts with ``prior`` counts from the order below. The
    dense form of what ``probabilities`` joins, for few symbols."""
    p = np.full(symbols, 1.0 / symbols)
    for k in range(1, order + 1):
        c = counts.reshape(-1, symbols**k).sum(axis=0).reshape(-1, symbols)  # n-grams of the last k tokens
        below = p.reshape(-1, symbols)
        lower = below[np.arange(len(c)) % len(below)]  # the context without its first token
        p = ((c + prior * lower) / (c.sum(axis=1, keepdims=True) + prior)).ravel()
    return np.log(p)


@dataclass
class Models:
    counts: DataFrame  # context, last, and the counts t of the target and b of the background
    symbols: int
    mass: tuple[int, int]  # tokens of both
    kept: np.ndarray | None = None
    order: int = ORDER

    def evidence(self) -> dict[str, Column]:
        """Counts of one mass; without a target both models are the background's."""
        b = F.col("b").cast("double")
        if not self.mass[0]:
            return {"t": b, "b": b}
        return {"t": F.col("t").cast("double"), "b": b * (self.mass[0] / self.mass[1] if self.mass[1] else 1.0)}


def train(docs: DataFrame, target: DataFrame, symbols: int | None = None, order: int = ORDER, text_col: str = "text") -> Models:
    """Models of ``target`` and of all ``docs``. With ``symbols`` all but the most frequent code points are one symbol."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    kept = None if symbols is None else vocabulary(docs, symbols, text_col)
    none = F.lit(0).cast("long")
    both = count_ngrams(target, kept, order, text_col).select("context", "last", F.col("n").alias("t"), none.alias("b"))
    both = both.unionAll(count_ngrams(docs, kept, order, text_col).select("context", "last", none.alias("t"), F.col("n").alias("b")))
    return models_of(both, symbols, kept, order)


def models_of(both: DataFrame, symbols: int | None, kept: np.ndarray | None, order: int) -> Models:
    """Models of counts (context, last, t, b) of which several rows may be of one n-gram."""
    counts = cut(both.groupBy("context", "last").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "lm-counts")
    sums = counts.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count_distinct("last").alias("symbols")).first()
    return Models(counts, symbols or sums.symbols + 1, (sums.t or 0, sums.b or 0), kept, order)


def own_probabilities(models: Models, prior: float = PRIOR) -> DataFrame:
    """The n-grams of the models (context, last; each once) with their log-probabilities t and b.

    Each order's n-grams take those of the order below, so that only the highest order is a join of the whole table. A
    window is the n-grams of one context, at most one for each symbol.
    """
    levels = [models.counts]
    for k in range(models.order - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
        levels.append(levels[-1].groupBy(shorter.alias("context"), "last").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    below = None
    for k, level in enumerate(reversed(levels), 1):
        within = Window.partitionBy("context")
        found = level.select("context", "last", *[c.alias(x) for x, c in models.evidence().items()], *[F.sum(c).over(within).alias(f"n{x}") for x, c in models.evidence().items()])
        if below is None:
            found = found.withColumns({f"p_{x}": F.lit(1.0 / models.symbols) for x in "tb"})
        else:
            shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 2)) - 1))
            found = found.join(below, (shorter == F.col("_h")) & (F.col("last") == F.col("_c")))
        p = {x: (F.col(x) + prior * F.col(f"p_{x}")) / (F.col(f"n{x}") + prior) for x in "tb"}
        found = found.select("context", "last", *[c.alias(x) for x, c in p.items()])
        below = found.select(F.col("context").alias("_h"), F.col("last").alias("_c"), F.col("t").alias("p_t"), F.col("b").alias("p_b"))
    return found.select("context", "last", F.log("t").alias("t"), F.log("b").alias("b"))


def probabilities(grams: DataFrame, models: Models, prior: float = PRIOR) -> DataFrame:
    """``grams`` (context, last; each once), also such as the models lack, with the log-probabilities t and b."""
    counts = models.counts.select("context", "last", *[c.alias(x) for x, c in models.evidence().items()])
    within = lambda k: F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))  # noqa: E731  the context's last k - 1 symbols
    found = grams.withColumns({f"p_{x}": F.lit(1.0 / models.symbols) for x in "tb"})
    for k in range(1, models.order + 1):
        level = counts.groupBy(within(k).alias("_h"), F.col("last").alias("_c")).agg(F.sum("t").alias("_t"), F.sum("b").alias("_b"))
        above = level.groupBy(F.col("_h").alias("_g")).agg(F.sum("_t").alias("_nt"), F.sum("_b").alias("_nb"))
        if k <= 2:  # a row for each symbol at most, and few keys
            above = F.broadcast(above)
        if k == 1:
            level = F.broadcast(level)
        found = found.join(level, (within(k) == F.col("_h")) & (F.col("last") == F.col("_c")), "left").join(above, within(k) == F.col("_g"), "left")
        p: dict[str, Column] = {f"p_{x}": (F.coalesce(f"_{x}", F.lit(0.0)) + prior * F.col(f"p_{x}")) / (F.coalesce(f"_n{x}", F.lit(0.0)) + prior) for x in "tb"}
        found = found.select("context", "last", *[c.alias(name) for name, c in p.items()])
    return found.select("context", "last", F.log("p_t").alias("t"), F.log("p_b").alias("b"))


def in_pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and piece, in a table bucketed by piece: rows that follow one another are of one piece up to ``PIECE``
    bytes. They are written before that shuffle, as a task that is repeated could meet its rows in another order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            upto = done + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            piece = base + np.concatenate(([done], upto[:-1])) // PIECE if len(upto) else upto
            done = int(upto[-1]) if len(upto) else done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece, pa.int64())], names=["doc_id", "text", "piece"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = cut(plain.mapInArrow(of, "doc_id long, text string, piece long"), "lm-pieces")
    spark, name = docs.sparkSession, f"lm_pieces_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(max(LEAST_BUCKETS, -(-pieces.select("piece").distinct().count() // PER_BUCKET)), most)
    written = pieces.repartition(buckets, "piece").write.option("compression", "zstd").option("path", f"{run_dir(spark)}/{name}")
    written.bucketBy(buckets, "piece").sortBy("piece").saveAsTable(name)
    bucketed = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: files with a path of their own stay until the run's folder goes
    return bucketed


def ngrams_of_pieces(pieces: DataFrame, target: DataFrame | None, order: int = ORDER, kept: np.ndarray | None = None) -> DataFrame:
    """piece, context, last, and counts t and b in the rows whose id is in ``target`` (doc_id; each once) and in all,
    written. Ids meet the pieces' ids and go on as one row for each piece that has them; texts stay in their bucket."""
    ids = pieces.where("doc_id IS NOT NULL").select(F.col("piece").alias("at"), F.col("doc_id").alias("id")).distinct()
    marks = ids.limit(0) if target is None else ids.join(target, F.col("id") == F.col("doc_id"), "left_semi")

    def told(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked = np.zeros(texts.num_rows, dtype=bool)
        if marks.num_rows:
            marked = pc.is_in(texts["doc_id"], value_set=marks["id"].combine_chunks()).to_numpy(zero_copy_only=False)
        parts = list(distinct_marked([t or "" for t in texts["text"].to_pylist()], marked, order, kept))
        columns = [np.concatenate(x) for x in zip(*parts)]
        piece = np.full(len(columns[0]), texts["piece"][0].as_py(), dtype=np.int64)
        return pa.table([pa.array(c, pa.int64()) for c in (piece, *columns)], names=["piece", "context", "last", "t", "b"])

    grams = pieces.groupBy("piece").cogroup(marks.groupBy("at")).applyInArrow(told, "piece long, context long, last long, t long, b long")
    return cut(grams, "lm-grams")


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss (per token) and score, their difference."""
    pieces = in_pieces(docs, id_col, text_col)
    grams = ngrams_of_pieces(pieces, None, models.order, models.kept).select("piece", "context", "last")
    return _losses(pieces, grams, probabilities(grams.select("context", "last").distinct(), models), models)


def score_against(docs: DataFrame, target: DataFrame, symbols: int | None = None, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of ``docs`` under models of all of them and of the rows among them whose id is in ``target`` (doc_id)."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    kept = None if symbols is None else vocabulary(docs, symbols, text_col)
    pieces = in_pieces(docs, id_col, text_col)
    grams = ngrams_of_pieces(pieces, target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), order, kept)
    models = models_of(grams.drop("piece"), symbols, kept, order)
    return _losses(pieces, grams.select("piece", "context", "last"), own_probabilities(models), models)


def _losses(pieces: DataFrame, grams: DataFrame, found: DataFrame, models: Models) -> DataFrame:
    """Losses of the documents of ``pieces`` by the log-probabilities ``found`` of their n-grams."""
    order, kept = models.order, models.kept

    def losses(texts: pa.Table, known: pa.Table) -> pa.Table:
        s, ends, sizes = tokens([t or "" for t in texts["text"].to_pylist()], order, kept)
        context, last, t, b = (known[c].to_numpy() for c in ("context", "last", "t", "b"))
        symbols_of = [*((context >> BITS * k) & ((1 << BITS) - 1) for k in reversed(range(order - 1))), last]
        found = []
        for symbols, grams in numbered(s, ends, order):
            place = np.full(ALL, -1, dtype=np.int64)
            place[symbols] = np.arange(len(symbols))
            number, here = np.zeros(len(last), dtype=np.int64), np.ones(len(last), dtype=bool)
            for x in symbols_of:
                at = place[x]
                here &= at >= 0
                number = number * len(symbols) + at
            rows = np.flatnonzero(here)
            rows = rows[np.argsort(number[rows])]
            at = rows[np.searchsorted(number[rows], grams)]
            found.append((t[at], b[at]))
        starts = np.cumsum(sizes) - sizes
        sums = [-np.add.reduceat(np.concatenate(x), starts) / sizes for x in zip(*found)]
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": pa.array(sizes, pa.int64()), "target_loss": sums[0], "background_loss": sums[1]})

    known = grams.join(cut(found, "lm-probabilities"), ["context", "last"])
    judged = pieces.groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(losses, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return judged.select("*", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids that are marked good, each once."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def labelled_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents that are marked good, all of them, for ``train``. Their ids go to the texts by broadcast where, counted,
    they are at most ``BROADCAST_IDS``; more are joined by a sort-merge join, which shuffles the texts."""
    good = cut(good_ids(labels), "good-ids")
    few = good.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(good) if few else good.hint("merge"), "doc_id", "left_semi")
