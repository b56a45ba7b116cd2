"""Divergence of the sources of a language, in exact whole numbers.

Terms are counted by language and source inside tasks, then by a grouped sum. A language keeps its terms that are in at
least ``least`` of its documents. A group's probability of a term is smoothed and scaled to a whole number, and the
divergence of two groups is a sum over all kept terms of a whole number for each. Those sums are made by a heavy-light
split: terms that are in more than ``HEAVY`` of a language's sources fill dense numpy tiles (sources by terms); of all
others the sum is that of two absent counts times their number, plus one-sided corrections by distinct probability for
each source that has such terms, plus corrections for the pairs of sources inside a term's posting list. Both parts are
sums of 64-bit numbers and are added exactly.

Postings of a language are dealt into chunks by a hash of the term, so that a language with a third of all rows is
spread over many tasks; a chunk meets the parameters of its language's groups in a cogroup, so that nothing is
broadcast or fetched. A chunk gives one partial sum for each pair of groups, which the result has anyway. Where a
language has so many sources that a task can't hold them squared, its pairs are dealt by blocks of rows too.

Memory: a counting task holds ``MOST`` terms before it gives them away; a chunk holds some ``POSTINGS`` postings (more,
up to 16 times that, for languages with many sources) and ``CELLS`` partial sums.

Defined results: null text, language and source count as empty; every row is a document, repeated rows too; texts of
any length are read whole; every group that occurs is in the result of ``pair`` if its language has another source, even
without terms; terms compare by their UTF-8 bytes; ties of value go by item; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.shared import cut

LEAST, SCALE, SMOOTH, TOP = 3, 1_000_000_000, 1, 200
MOST, POSTINGS, CELLS, HEAVY = 300_000, 200_000, 4_000_000, 0.25
#: Bytes of terms, A-Z as a-z; all other ASCII bytes part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = MOST) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; the term '' stands for the group itself and counts its documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def given() -> pa.RecordBatch:
            sizes = [len(docs) for _, docs in found.values()]
            lang, source = (pa.array([x for key, size in zip(found, sizes) for x in [key[k]] * size], pa.string()) for k in (0, 1))
            terms = pa.array([t for _, docs in found.values() for t in docs], pa.binary()).cast(pa.string())
            n = pa.array([total[t] for total, docs in found.values() for t in docs], pa.int64())
            made = pa.RecordBatch.from_arrays([lang, source, terms, n, pa.array([d for _, docs in found.values() for d in docs.values()], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            found.clear()
            return made

        for batch in batches:
            for text, lang, source in zip(batch.column(2).cast(pa.binary()), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.as_py().translate(TERM_BYTES).split()
                total, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(docs)
                total.update(words)
                docs.update(set(words))
                docs[b""] += 1
                held += len(docs) - before
                if held > most:
                    yield given()
                    held = 0
        yield given()

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(of, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)); the product needs more than 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + SMOOTH * kept).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The tables that both parts of the audit read, written once."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST):
        by_term = Window.partitionBy("lang", "term")  # a row for each source of the language at most
        counts = term_counts(docs, text_col, lang_col, source_col)
        seen = counts.withColumns({
            "in_docs": F.sum("docs").over(by_term), "n_lang": F.sum("n").over(by_term), "k": F.count("*").over(by_term), "nth": F.row_number().over(by_term.orderBy("source")),
        })
        self.kept = cut(seen.where((F.col("in_docs") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "n_lang", "k", "nth"), "kept-terms")
        terms = self.kept.where("term <> ''")
        own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        of_lang = terms.groupBy("lang").agg(F.count_if(F.col("nth") == 1).alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("postings"))
        groups = self.kept.where("term = ''").select("lang", "source", (F.col("nth") - 1).alias("idx"), F.col("k").alias("sources"))
        whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        self.groups = cut(
            groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", "idx", "sources", *map(whole, ("total", "kept", "lang_total", "postings"))),
            "groups",
        )  # a row for each group; the result has their square
        rated = terms.join(self.groups.drop("postings"), ["lang", "source"])
        self.rated = rated.withColumn("p", scaled(F.col("n"), F.col("total"), F.col("kept")))

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value and rank of the terms that a source has more often than its language, the first ``top``."""
        q = scaled(F.col("n_lang"), F.col("lang_total"), F.col("kept"))
        above = self.rated.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # tasks keep ``top`` of each before the shuffle
        return above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    def pair_sums(self, postings: int = POSTINGS, cells: int = CELLS, heavy: float = HEAVY) -> DataFrame:
        """lang, idx, other and value for each ordered pair of a language's sources."""
        chunk_size = F.least(F.greatest(F.lit(4) * F.col("sources") * F.col("sources"), F.lit(postings)), F.lit(16 * postings))
        chunks = F.greatest(F.ceil(F.col("postings") / chunk_size), F.lit(1))
        rows = F.greatest(F.floor(F.lit(cells) / F.col("sources")), F.lit(1))  # of the square that a task makes
        sized = self.groups.where("sources > 1").withColumns({"chunks": chunks, "rows": rows})
        blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / F.col("rows")))
        p0 = scaled(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))
        params = sized.select("lang", "rows", F.col("idx").cast("long").alias("idx"), F.when(F.col("kept") > 0, p0).otherwise(1).alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "sources")
        params = params.select("lang", "chunk", F.explode(blocks).alias("block"), "rows", "idx", "p0")
        of_lang = sized.select("lang", "source", "chunks", "rows")
        dealt = self.rated.select("lang", "source", "term", F.col("idx").cast("long").alias("idx"), "p", "k", "sources").join(of_lang, ["lang", "source"])
        dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), F.explode(blocks).alias("block"), "term", "idx", "p", "k")

        def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["lang", "idx", "other", "value"]
            if not right.num_rows:  # can't be: every chunk of a language has its parameters
                raise ValueError(f"postings without a group: {key}")
            p0 = np.empty(right.num_rows, np.int64)
            p0[right["idx"].to_numpy()] = right["p0"].to_numpy()
            size, at = right["rows"][0].as_py(), key[2].as_py()
            lo, hi = size * at, min(size * (at + 1), len(p0))
            codes = pc.dictionary_encode(left["term"].combine_chunks()) if left.num_rows else None
            codes = np.empty(0, np.int64) if codes is None else (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy().astype(np.int64)
            made = block_sums(codes, left["idx"].to_numpy(), left["p"].to_numpy(), left["k"].to_numpy(), p0, lo, hi, heavy, cells)
            g, h = np.nonzero(np.arange(lo, hi)[:, None] != np.arange(len(p0))[None, :])
            return pa.table([pa.array([key[0].as_py()] * len(g), pa.string()), pa.array(g + lo), pa.array(h), pa.array(made[g, h])], names=names)

        parts = dealt.groupBy("lang", "chunk", "block").cogroup(params.groupBy("lang", "chunk", "block")).applyInArrow(sums, "lang string, idx long, other long, value long")
        return parts.groupBy("lang", "idx", "other").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """lang, source, item (the other source), value and rank of all pairs of a language's sources."""
        summed = cut(self.pair_sums(), "pair-sums")
        named = lambda at, name: self.groups.select("lang", F.col("idx").cast("long").alias(at), F.col("source").alias(name))
        both = summed.join(named("idx", "source"), ["lang", "idx"]).join(named("other", "item"), ["lang", "other"])
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row for each other source
        return both.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def block_sums(term: np.ndarray, idx: np.ndarray, p: np.ndarray, k: np.ndarray, p0: np.ndarray, lo: int, hi: int, heavy: float = HEAVY, cells: int = CELLS) -> np.ndarray:
    """Sums over the chunk's terms for sources lo to hi against all; postings are (term, idx, p), k their term's number
    of postings, p0 what an absent count gives. 64-bit sums may wrap in between and are right in the end."""
    n = len(p0)
    out = np.zeros((hi - lo, n), np.int64)
    dense = k > max(heavy * n, 1)
    # Heavy terms: tiles of sources by terms.
    codes, where = np.unique(term[dense], return_inverse=True)
    width = max(1, cells // n)
    for start in range(0, len(codes), width):
        inside = (where >= start) & (where < start + width)
        tile = np.repeat(p0[:, None], min(width, len(codes) - start), axis=1)
        tile[idx[dense][inside], where[inside] - start] = p[dense][inside]
        for g in range(lo, hi):
            out[g - lo] += apart(tile[g][None, :], tile).sum(axis=1)
    # Light terms: what two absent counts give, ...
    term, idx, p, k = (x[~dense] for x in (term, idx, p, k))
    codes, where = np.unique(term, return_inverse=True)
    have = np.bincount(idx, minlength=n)
    out += (len(codes) - have[lo:hi, None] - have[None, :]) * apart(p0[lo:hi, None], p0[None, :])
    # ... one-sided corrections, ...
    for g in np.flatnonzero(have):
        values, times = np.unique(p[idx == g], return_counts=True)
        for start in range(0, len(values), width):
            v, m = values[start : start + width, None], times[start : start + width, None]
            if lo <= g < hi:
                out[g - lo] += (m * apart(v, p0[None, :])).sum(axis=0)
            out[:, g] += (m * apart(p0[None, lo:hi], v)).sum(axis=0)
    # ... and corrections of pairs within a posting list.
    order = np.argsort(where, kind="stable")
    idx, p, k = idx[order], p[order], k[order]
    for size in np.unique(k[k > 1]).tolist():
        mine = np.flatnonzero(k == size)
        lists_i, lists_p = idx[mine].reshape(-1, size), p[mine].reshape(-1, size)
        step = max(1, cells // (size * size))
        for start in range(0, len(lists_i), step):
            i, x = lists_i[start : start + step], lists_p[start : start + step]
            gi, hi_ = np.broadcast_arrays(i[:, :, None], i[:, None, :])
            pg, ph = np.broadcast_arrays(x[:, :, None], x[:, None, :])
            inside = (gi >= lo) & (gi < hi)
            gi, hi_, pg, ph = gi[inside], hi_[inside], pg[inside], ph[inside]
            np.add.at(out, (gi - lo, hi_), apart(pg, ph) - apart(pg, p0[hi_]) - apart(p0[gi], ph) + apart(p0[gi], p0[hi_]))
    return out


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    made = Audit(docs, text_col, lang_col, source_col, least)
    shown = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown("pair", made.pairs()).unionByName(shown("term", made.terms(top)))
