"""Packing of tokenised documents into windows of fixed capacity by minimum bin slack.

Documents are tokenised once and cut into pieces of at most one window; full pieces are sequences of their own and
are never moved. The remainders are dealt evenly into shards of some 4,096 by a hash of the row number, whatever their
lengths, and each shard is packed by itself: the longest remainder opens a window, a bitset subset-sum over the multiset of
remaining lengths finds the filling closest to capacity, and backtracking gives its counts. The filling is repeated
while the counts allow. Only where no filling is exact a piece is cut, so that at most the last window of a shard has
padding.

Defined results: a null text is an empty one, that is the end token alone; every row is its own document, whether its
id is null or repeats; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import cut
from rankloom.llm.units import UnitEncoder, in_slices, threaded

CAPACITY, END, SHARD = 1024, 0, 4096
#: The space and the line feed as byte-level tokenizers write them in their tokens.
SPACE, FEED = "\u0120", "\u010a"
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> UnitEncoder:
    """The encoder of a worker, from the tokenizer's definition in JSON."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer)
    leads = np.zeros(tok.get_vocab_size(), dtype=bool)
    leads[[i for token, i in tok.get_vocab().items() if token[0] in (SPACE, FEED)]] = True

    def encode(units: list[str]) -> list[list[int]]:
        threaded(False)  # Spark has a task on each core already
        return [e.ids for e in tok.encode_batch_fast(units, add_special_tokens=False)]

    return UnitEncoder(encode, leads, most=700_000, parted=True)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut every ``capacity`` ids. ``tokenizer``: its definition in JSON."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    last = end.to_bytes(4, "little")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for begin, texts in in_slices(batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in zip(doc_ids[begin:], ids_of(texts)):
                    ids += last
                    total = len(ids) // 4
                    rows += [(doc_id, at, min(capacity, total - at), total, ids[4 * at : 4 * (at + capacity)]) for at in range(0, total, capacity)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()])], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(of, PIECE)


def best_fill(room: int, counts: dict[int, int]) -> tuple[dict[int, int], int]:
    """The multiset of lengths whose sum comes closest to ``room`` from below: its counts, and the sum."""
    bits, mask, trail = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0 and not bits >> room & 1:  # powers of two, so that few steps make any count
            take = min(step, left)
            more = bits | bits << length * take & mask
            if more != bits:
                trail.append((length, take, bits))
                bits = more
            left, step = left - take, step * 2
    at = total = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used, total


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of parts: the item's place in ``lengths``, where the part begins in it, and the part's length."""
    stacks: dict[int, list[tuple[int, int]]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[k], []).append((k, 0))
    windows = []

    def take(length: int) -> tuple[int, int, int]:
        item = stacks[length].pop()
        if not stacks[length]:
            del stacks[length]
        return *item, length

    while stacks:
        opener = max(stacks)
        counts = {n: len(s) for n, s in stacks.items()}
        counts[opener] -= 1
        used, total = best_fill(capacity - opener, {n: c for n, c in counts.items() if c})
        slack = capacity - opener - total
        need = used | {opener: used.get(opener, 0) + 1}
        times = 1 if slack else min(len(stacks[n]) // c for n, c in need.items())
        for _ in range(times):
            windows.append([take(n) for n, c in sorted(need.items(), reverse=True) for _ in range(c)])
        if slack and stacks:  # every length left exceeds the slack, or the filling would hold it
            k, at, length = take(max(stacks))
            windows[-1].append((k, at, slack))
            stacks.setdefault(length - slack, []).append((k, at + slack))
    return windows


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian)."""
    cut_up = cut(pieces(docs, tokenizer, capacity, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < capacity
    full = cut_up.where(~part).select("doc_id", "start", "length", "doc_tokens", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    shards = max(1, -(-cut_up.where(part).count() // shard))

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        ids, starts = frame["ids"].tolist(), frame["start"].tolist()
        rows = []
        for n, window in enumerate(pack(frame["length"].tolist(), capacity)):
            offset = 0
            for k, at, length in window:
                rows.append((k, starts[k] + at, length, 2 * (key[0] << 32 | n) + 1, offset, ids[k][4 * at : 4 * (at + length)]))
                offset += length
        out = pd.DataFrame(rows, columns=["k", "start", "length", "sequence_id", "offset", "ids"])
        for name in ("doc_id", "doc_tokens"):
            out[name] = frame[name].array.take(out["k"])
        return out.drop(columns="k")

    packed = (
        cut_up.where(part)
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)) if shards > 1 else F.lit(0).cast("long"))
        .groupBy("shard")
        .applyInPandas(of, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    )
    return full.unionByName(packed)


def load_tokenizer(path: str) -> str:
    """The definition in a tokenizer's JSON file, read where the driver runs."""
    with open(path, encoding="utf-8") as f:
        return f.read()
