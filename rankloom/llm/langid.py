"""Language identification: a linear-chain conditional random field that labels every word of a whole text.

A word is a run of letters (with marks, and numbers beyond ASCII). Its features are its byte 1- to 4-grams with the blank on either side, so those with a
blank are its affixes, and its identity if it is in the lexicon (the words frequent in the sample). Transitions
between the languages of neighbouring words are learned with the feature weights by full-batch gradient steps on
sequences spliced from segments of differently labelled texts, so that switching within a text is seen in training.
Forward-backward gives each word its marginal probabilities; a document takes the language with the highest mean.

The fit takes a sample of every language: the first ``per_lang`` documents of each by a hash of the id, or all where a
language has fewer, and fewer (``LEAST`` at least) only where there are more than 64 languages. How long texts are has
no part in that. Of a drawn text longer than its share of characters (``CHARS``, or less where ``CELLS`` words times
languages would be passed) as many segments, spread evenly from its beginning to its end, are learned from, so that the
driver's memory is bounded; no labelled text is cut. Labelling is vectorised over the documents of a batch and reads
each text to its end: a text of more than ``LONG`` characters is taken in blocks, and its chain is solved in parallel
pieces that are tied together by their transfer matrices, which gives the same marginals.

Defined results: an empty table gives no rows; ``und`` with score 0 where the text is null or has no letter, or nothing could be learned; rows are
judged one by one, so repeated rows and null ids get their own rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.quality import span_hashes
from rankloom.llm.shared import KEY, hash_share, held_out

PER_LANG, LEAST, SAMPLE, CHARS, BITS = 120, 24, 64 * 120, 8000, 15
#: Words times languages of a fit at most, at some six characters a word, and the segments of a text that is longer than
#: its share.
CELLS, SEGMENTS = 12_000_000, 8
#: Characters from which a text is labelled in blocks.
LONG = 1_000_000
#: A letter of any script. The standard library's word characters hold numerals that are none.
LETTER = regex.compile(r"\p{L}")
#: Bytes of longer characters that are no letters, marks or numbers would join words: they become blanks.
OTHER = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]+")
#: Everything in ASCII that is no letter parts words; bytes of longer characters belong to them.
BLANKS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all words of the texts: feature numbers (4 x bytes, 1 << bits for none), the byte where each word's features
    begin, a hash of each word, and the number of words in each text."""
    low = [t.lower() for t in texts]
    plain = [(t if t.isascii() else OTHER.sub(" ", t)).encode("utf-8", "ignore").translate(BLANKS) for t in low]
    raw = np.frombuffer(b" " + b"  ".join(plain) + b"     ", dtype=np.uint8)
    blank = raw == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    hashes = span_hashes(raw.astype(np.uint64), starts, ends)
    n = len(raw) - 4
    key = raw.astype(np.uint32)
    none = np.int32(1 << bits)
    out = np.empty((4, n), dtype=np.int32)
    code, inside = key[:n].copy(), ~blank[:n]
    for k in range(4):
        if k:
            code = code << np.uint32(8) | key[k : n + k]
        good = ~blank[:n] if k == 0 else ~(blank[:n] & blank[1 : n + 1]) if k == 1 else inside
        mixed = (code + np.uint32(k * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        out[k] = np.where(good, (mixed >> np.uint32(32 - bits)).astype(np.int32), none)
        inside = ~blank[1 : n + 1] if k <= 1 else inside & ~blank[k : n + k]  # no blank within the window
    sizes = np.array([len(p) for p in plain])
    bounds = np.cumsum(sizes + 2)
    words = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return out, starts - 1, hashes, words


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # a row for each feature, and a last one of zeros
    lexicon: np.ndarray  # sorted hashes
    word_weight: np.ndarray  # a row for each word of the lexicon, and a last one of zeros
    start: np.ndarray
    trans: np.ndarray

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, hashes)
        at[at == len(self.lexicon)] = 0
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(hashes), dtype=int)

    def emissions(self, feats: np.ndarray, begins: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """Scores of each word for each language, at most 0 and at least -40."""
        total = self.weight[feats[0]]
        for row in feats[1:]:
            total += self.weight[row]
        e = np.add.reduceat(total, begins, axis=0) + self.word_weight[lex]
        return np.maximum(e - e.max(axis=1, keepdims=True), -40)


def forward_backward(em: np.ndarray, lengths: np.ndarray, begins: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and with ``pairs`` the summed marginals of neighbours.

    ``em``, ``start`` and ``trans`` are likelihoods, not logarithms; sequences are given longest first, all at least 1.
    """
    alpha, gamma = np.empty_like(em), np.empty_like(em)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    a = start * em[begins]
    a /= a.sum(axis=1, keepdims=True)
    alpha[begins] = a
    for t in range(1, steps):
        at = begins[: active[t]] + t
        a = (a[: len(at)] @ trans) * em[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    both = np.zeros_like(trans)
    beta = np.ones((len(begins), em.shape[1]), dtype=em.dtype)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            k = active[t + 1]
            ahead = beta[:k] * em[begins[:k] + t + 1]
            if pairs:
                before = alpha[begins[:k] + t]
                both += (before / ((before @ trans) * ahead).sum(axis=1, keepdims=True)).T @ ahead * trans
            back = ahead @ trans.T
            beta[:k] = back / back.sum(axis=1, keepdims=True)
        at = begins[: active[t]] + t
        g = alpha[at] * beta[: len(at)]
        gamma[at] = g / g.sum(axis=1, keepdims=True)
    return gamma, both


def splice(labels: np.ndarray, rng: np.random.Generator, length: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the words in which segments of 8 to 40 follow one another at random, cut into sequences."""
    cuts, at = [], 0
    while at < len(labels):
        cuts.append(at)
        at += int(rng.integers(8, 41))
    parts = np.split(np.arange(len(labels)), cuts[1:])
    order = np.concatenate([parts[k] for k in rng.permutation(len(parts))])
    begins = np.arange(0, len(order), length)
    return order, begins, np.diff(np.append(begins, len(order)))


def fit(texts: list[str], langs: list[str], bits: int = BITS, steps: int = 30, rate: float = 0.15, decay: float = 2e-3, frequent: int = 5, seed: int = 0) -> Model:
    """Adam on the mean log-likelihood of the words, from zero weights."""
    names = sorted(set(langs))
    feats, begins, hashes, words = word_features(texts, bits)
    y = np.repeat(np.searchsorted(names, langs), words) if len(texts) else np.zeros(0, dtype=int)
    known, counts = np.unique(hashes, return_counts=True)
    size = len(names)
    model = Model(names, np.zeros(((1 << bits) + 1, size)), known[counts >= frequent], np.zeros((int((counts >= frequent).sum()) + 1, size)), np.zeros(size), np.zeros((size, size)))
    if size > 1 and len(y):
        # Features are summed once for each different word, whichever times it occurs.
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        spans = np.diff(np.append(begins, feats.shape[1]))[first]
        begins_u = np.cumsum(spans) - spans
        feats_u = feats[:, np.repeat(begins[first] - begins_u, spans) + np.arange(spans.sum())]
        lex = model.lexicon_rows(hashes[first])
        flat, owners = feats_u.ravel(), np.tile(np.repeat(np.arange(len(first)), spans), 4)
        order, heads, lengths = splice(y, np.random.default_rng(seed))
        want = np.zeros((len(y), size))
        want[np.arange(len(y)), y] = 1
        seen = np.zeros((size, size))
        inner = np.setdiff1d(np.arange(1, len(order)), heads)
        np.add.at(seen, (y[order[inner - 1]], y[order[inner]]), 1)
        params = [model.weight, model.word_weight, model.start, model.trans]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            em = np.exp(model.emissions(feats_u, begins_u, lex))[which[order]]
            gamma, both = forward_backward(em, lengths, heads, np.exp(model.start), np.exp(model.trans), pairs=True)
            gap = np.empty_like(gamma)
            gap[order] = gamma
            gap -= want
            word_gap = np.column_stack([np.bincount(which, gap[:, k], len(first)) for k in range(size)])
            grads = [np.column_stack([np.bincount(flat, word_gap[owners, k], len(model.weight)) for k in range(size)]), np.column_stack([np.bincount(lex, word_gap[:, k], len(model.word_weight)) for k in range(size)]), gap[order[heads]].sum(axis=0), both - seen]
            for p, g, m, v in zip(params, grads, mean, var):
                g = g / len(y) + decay / len(y) * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            model.weight[-1] = model.word_weight[-1] = 0
    return model


def segments(text: Column, most: int) -> Column:
    """The text, or of a longer one ``SEGMENTS`` segments of ``most`` characters in all, spread evenly over it."""
    size = max(1, most // SEGMENTS)
    step = (F.length(text) - size) / F.lit(float(SEGMENTS - 1))
    parts = [F.substr(text, (F.floor(step * k) + 1).cast("int"), F.lit(size)) for k in range(SEGMENTS)]
    return F.when(F.length(text) > most, F.concat_ws(" ", *parts)).otherwise(text)


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on ``per_lang`` documents of every language, or its share of ``SAMPLE``, without the held-out fold. What the
    driver fits on is bounded in rows and in characters, and every language that has rows is in it."""
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return fit([], [])
    each = min(per_lang, max(LEAST, SAMPLE // len(counts)))
    most = max(SEGMENTS, min(CHARS, 6 * CELLS // (len(counts) ** 2 * each)))
    # Four times as many rows as are wanted by the hash alone, and of those the first, so that few rows are sorted.
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 4 * each / r.n)) for r in counts], "lang string, share double")
    drawn = rows.withColumn("at", hash_share(F.col("doc_id"), F.lit(7))).join(F.broadcast(shares), "lang").where(F.col("at") < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text")))
    first = drawn.select("lang", "at", "doc_id", segments(F.col("text"), most).alias("text")).withColumn("nth", nth).where(F.col("nth") <= each)
    sample = first.select("lang", "text").toPandas().sort_values(["lang", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def chain_marginals(em: np.ndarray, start: np.ndarray, trans: np.ndarray, piece: int | None = None) -> np.ndarray:
    """The marginals that ``forward_backward`` gives, for one long sequence: pieces of it are worked on side by side.

    A piece's transfer matrix, the product of its steps, carries the forward vector over it from the left and the backward
    vector from the right; with both known at its ends a piece is solved alone.
    """
    n, size = em.shape
    piece = piece or max(1, int(np.sqrt(n)))
    body = em[1:].astype(np.float64)
    full = (n - 1) // piece
    steps, tail = body[: full * piece].reshape(full, piece, size), body[full * piece :]
    over = np.broadcast_to(np.eye(size), (full, size, size)).copy()
    for t in range(piece):
        over = (over @ trans) * steps[:, t, None, :]
        over /= over.max(axis=(1, 2), keepdims=True)
    unit = lambda v: v / v.sum(axis=-1, keepdims=True)
    alpha, gamma = np.empty((n, size)), np.empty((n, size))
    alpha[0] = unit(start * em[0])
    left = np.empty((full, size))
    at = alpha[0]
    for j in range(full):
        left[j] = at
        at = unit(at @ over[j])
    inside = alpha[1 : 1 + full * piece].reshape(full, piece, size)
    for t in range(piece):
        left = unit((left @ trans) * steps[:, t])
        inside[:, t] = left
    for t in range(len(tail)):
        at = alpha[1 + full * piece + t] = unit((at @ trans) * tail[t])
    back = np.ones(size)
    for t in range(len(tail) - 1, -1, -1):
        gamma[1 + full * piece + t] = unit(alpha[1 + full * piece + t] * back)
        back = unit(trans @ (tail[t] * back))
    right = np.empty((full, size))
    for j in range(full - 1, -1, -1):
        right[j] = back
        back = unit(over[j] @ back)
    gamma[0] = unit(alpha[0] * back)
    of = gamma[1 : 1 + full * piece].reshape(full, piece, size)
    for t in range(piece - 1, -1, -1):
        of[:, t] = unit(inside[:, t] * right)
        right = unit((steps[:, t] * right) @ trans.T)
    return gamma


def blocks(text: str, size: int) -> Iterator[str]:
    """The text in blocks of some ``size`` characters, parted at spaces."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def label(texts: list[str | None], model: Model, size: int = LONG) -> Iterator[tuple[int, str, float, np.ndarray]]:
    """For each text, in an order of its own: its place, language, score and the marginals of its words."""
    fine = [k for k, t in enumerate(texts) if t and model.langs and LETTER.search(t)]
    for k in set(range(len(texts))) - set(fine):
        yield k, "und", 0.0, np.zeros((0, len(model.langs)))
    fine.sort(key=lambda k: -len(texts[k]))  # long texts together, so that few steps are taken for few texts
    start, trans = np.exp(model.start), np.exp(model.trans)
    bits = len(model.weight).bit_length() - 1

    def likelihoods(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        feats, begins, hashes, words = word_features(some, bits)
        return (np.exp(model.emissions(feats, begins, model.lexicon_rows(hashes))) if len(begins) else np.zeros((0, len(model.langs)))), words

    def told(k: int, g: np.ndarray) -> tuple[int, str, float, np.ndarray]:
        mean = g.mean(axis=0) if len(g) else np.zeros(len(model.langs))
        best = int(mean.argmax())
        return k, model.langs[best] if len(g) else "und", float(mean[best]), g

    while fine and len(texts[fine[0]]) > size:
        k = fine.pop(0)
        em = np.concatenate([likelihoods([part])[0] for part in blocks(texts[k], size)])
        yield told(k, chain_marginals(em, start, trans) if len(em) else em)
    while fine:
        n, total = 0, 0
        while n < len(fine) and (not n or total < size):
            total += len(texts[fine[n]])
            n += 1
        run, fine = fine[:n], fine[n:]
        em, words = likelihoods([texts[k] for k in run])
        heads = np.cumsum(words) - words
        order = np.argsort(-words, kind="stable")
        full = order[: int((words > 0).sum())]
        gamma, _ = forward_backward(em, words[full], heads[full], start, trans)
        for j in range(n):
            yield told(run[j], gamma[heads[j] : heads[j] + words[j]])


def labeller(docs: DataFrame, model: Model):
    """A function of a text column that gives lang_pred and score."""
    small = Model(model.langs, model.weight.astype(np.float32), model.lexicon, model.word_weight.astype(np.float32), model.start.astype(np.float32), model.trans.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(small)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [None] * len(texts), np.zeros(len(texts))
        for k, lang, score, _ in label(texts.tolist(), shared.value):
            langs[k], scores[k] = lang, score
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.clip(scores, 0, 1)})

    return judge


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the mean marginal of that language)."""
    doc_id = F.col(f"`{id_col}`").cast("long")
    judged = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), labeller(docs, model)(F.col(f"`{text_col}`")).alias("of"))
    return judged.select("doc_id", "held_out", "of.lang_pred", "of.score")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents in a known language, with all their columns: those that aren't ``und``, whatever the number of
    languages."""
    of = labeller(docs, model)(F.col(f"`{text_col}`"))
    return docs.withColumn(KEY, of).where(F.col(f"{KEY}.lang_pred") != "und").drop(KEY)
