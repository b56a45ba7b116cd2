"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Features of a whole text are the sets of its word 1- and 2-grams and of its word-shape 1- to 3-grams, hashed. A word's
shape is the order of its character classes (lower, upper, digit, each mark), and whether it repeats the word before.
The log-count ratios and the hinge-loss model (dual coordinate descent) are fitted on a bounded sample of labelled
rows, ``per_class`` of each class, taken by a hash of the id; a fifth of it is kept back to calibrate the margin to a
probability. Scoring reads whole texts where Spark has them, a long one in blocks of ``BLOCK`` bytes, so that memory
doesn't grow with it beyond the text itself; only the sample's features come to the driver. A document that is there
twice is two rows to learn from.

Defined results: an empty table gives no rows; a null text is an empty one; an empty text has no features and gets the score of the bias alone;
without rows of both classes to learn from every score is the share of the class that there is, or one half; ids
labelled twice count once with the lower label; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import hash_share, held_out

BITS, PER_CLASS, THRESHOLD, BLOCK = 18, 2500, 0.7, 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_classes() -> np.ndarray:
    """0 for white space, 1 for lower case and bytes of longer characters, 2 upper case, 3 digits, else the byte itself."""
    out = np.arange(256, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[*range(97, 123), *range(128, 256)]] = 1
    out[65:91] = 2
    out[48:58] = 3
    return out


CLASS = byte_classes()
FOLD = np.arange(256, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint64)
POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 to the 64."""
    if not POWERS or len(POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, dtype=np.uint64)))) for base in (ODD, inverse)]
    return POWERS[0], POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of ``values``, wherever it stands."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((values + np.uint64(1)) * up[: len(values)])))
    return (sums[ends] - sums[starts]) * down[starts]


def grams(text: bytes, skip: int = 0) -> np.ndarray:
    """Hashes of the n-grams that end after the first ``skip`` words, in no order; the skipped ones only lead them."""
    raw = np.frombuffer(text, dtype=np.uint8)
    kind = CLASS[raw]
    edge = np.diff(np.concatenate(([0], (kind != 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = span_hashes(FOLD[raw], starts, ends)
    turn = np.concatenate(([True], kind[1:] != kind[:-1])) & (kind != 0)
    at = np.concatenate(([0], np.cumsum(turn)))
    shapes = span_hashes(kind[turn].astype(np.uint64), at[starts], at[ends]) * np.uint64(2)
    shapes[1:] += words[1:] == words[:-1]
    mix = ODD | np.uint64(1)
    two = shapes[:-1] * mix + shapes[1:]
    every = [words[skip:], (words[:-1] * mix + words[1:] + np.uint64(11))[max(skip - 1, 0) :], (shapes * mix + np.uint64(23))[skip:], (two * mix + np.uint64(37))[max(skip - 1, 0) :]]
    every.append(((two[:-1] * mix + shapes[2:]) * mix + np.uint64(51))[max(skip - 2, 0) :])
    return np.concatenate(every)


def features(text: bytes, bits: int = BITS, block: int = BLOCK) -> np.ndarray:
    """The hashed features that the text has, each once, in order. A longer text is taken in blocks, each of which begins
    with the last three words of the one before."""
    found, led, at = [], [], 0
    while at < len(text):
        gap = GAP.search(text, at + block)
        end = gap.start() if gap else len(text)
        part = b" ".join([*led, text[at:end]])
        every = grams(part, len(led))
        every ^= every >> np.uint64(29)
        every *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(np.unique((every >> np.uint64(64 - bits)).astype(np.int32)))
        led, at = part.rsplit(None, 3)[-3:], end
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(a * margin + b))); margin = sum of ``weight`` / root of the sum of ``square``, and bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, idx: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[idx].sum()))
        return (float(self.weight[idx].sum()) / norm if norm else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        z = self.a * self.margin(features(text, len(self.weight).bit_length() - 1)) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 1.0, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """The hinge-loss model of unit-length sparse rows and a constant: dual coordinate descent, in a random order each round."""
    rng, w, bias, alpha = np.random.default_rng(seed), np.zeros(size), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            g = y[i] * (w[idx] @ val + bias) - 1
            pg = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= c else g
            if pg:
                new = min(max(alpha[i] - g / (2.0 if len(idx) else 1.0), 0.0), c)
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                bias += step
                alpha[i] = new
                worst = max(worst, abs(pg))
        if worst < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a and b by Newton steps, towards targets drawn in by the class sizes."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(sample: list[tuple[int, bool, np.ndarray]], bits: int = BITS, alpha: float = 1.0) -> Model:
    """The model of rows (label, kept back for calibration, features)."""
    size = 1 << bits
    labels = {label for label, *_ in sample}
    if len(labels) < 2:
        share = sum(label for label, *_ in sample) / len(sample) if sample else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    learn = [(label, idx) for label, back, idx in sample if not back]
    if len({label for label, _ in learn}) < 2:
        learn = [(label, idx) for label, _, idx in sample]
    counts = np.full((2, size), alpha)
    for label, idx in learn:
        counts[label, idx] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for _, idx in learn:
        val = ratio[idx]
        rows.append((idx, val / (np.linalg.norm(val) or 1.0)))
    y = np.array([1.0 if label else -1.0 for label, _ in learn])
    w, bias = coordinate_descent(rows, y, size)
    model = Model(w * ratio, ratio**2, bias, 1.0, 0.0)
    back = [(label, idx) for label, kept, idx in sample if kept]
    if len({label for label, _ in back}) < 2:
        back = learn
    model.a, model.b = calibrate(np.array([model.margin(idx) for _, idx in back]), np.array([1 if label else -1 for label, _ in back]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on some ``per_class`` labelled rows of each class outside the held-out fold."""
    marked = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    share = {r.label: min(1.0, per_class / r.n) for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = marked.where(hash_share(F.col("doc_id"), F.lit(3)) < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = [features(t.as_py() or b"", bits).astype("<i4").tobytes() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.binary())], names=["label", "back", "idx"])

    rows = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # about 2 * per_class rows of two numbers, however many are labelled
        .select("label", (hash_share(F.col("doc_id"), F.lit(5)) < 0.2).alias("back"), "text")
        .mapInArrow(of, "label int, back boolean, idx binary")
        .toPandas()
    )
    rows = rows.sort_values(["label", "idx"], ignore_index=True)  # the fit doesn't hang on the order that tasks end in
    return fit([(int(r.label), bool(r.back), np.frombuffer(r.idx, dtype="<i4")) for r in rows.itertuples()], bits)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives the score."""
    small = Model(model.weight.astype(np.float32), model.square.astype(np.float32), model.bias, model.a, model.b)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score((t or "").encode()) for t in texts], dtype="float64")

    return score


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``threshold`` on, else 0)."""
    doc_id: Column = F.col(f"`{id_col}`").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(docs, model)(F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    return docs.where(scorer(docs, model)(F.col(f"`{text_col}`")) >= threshold)
