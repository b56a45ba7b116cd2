"""The prefix trie of conversations, built by radix partitioning from the first turn on.

Turns are known by a digest of role and text, and digests by dense numbers (a dictionary in a written table), so that
texts are read once and never shuffled. Conversations with equal sequences are one row with a count. Buckets hold the
sequences that share a prefix. A bucket with more than ``local`` turns left is split over the cluster: its longest
common prefix is skipped in one step, and the turn that follows deals its sequences into new buckets, again and again
until all are small (most significant digit first). Small buckets are sorted whole, many to a task, by multikey
quicksort, whose recursion emits the nodes. Numbers that a node gathers from below go up one written level at a time.

A step costs one small aggregate and one join whatever the number of buckets; there are as many steps as a large bucket
has branchings on the way down, not as it has turns. Conversations that end at a node are of one sequence; the digest of
their ids is streamed: ids are range-partitioned and joined to pieces of text in parallel, and a last pass hashes a
node's pieces in order, so that a sequence of a third of all conversations needs no memory for them.

Defined results: a null turn comes first, ties go by the digest of role and text, repeated rows are turns of their own;
a null role or text is empty; a row without conv_id belongs to no conversation and is left out; a conversation's turn
numbers (not its texts) are one row; an empty table gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.shared import cut

LOCAL, PIECE = 50_000, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
SEQ = "array<struct<id:long,words:long>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place from 0), digest and words of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")  # streamed: 56 bytes a turn
    return rows.withColumn("k", F.row_number().over(order) - 1).select("conv_id", "k", "digest", "words")


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with a dense id for each digest."""
    ids = cut(turns.groupBy("digest").agg(F.first("words").alias("words")).select("digest", F.monotonically_increasing_id().alias("id")), "turn-ids")
    return turns.join(ids, "digest").select("conv_id", "k", "id", "words")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq of each conversation. ``turns`` is (conv_id, k, id, words)."""
    of = F.sort_array(F.collect_list(F.struct("k", "id", "words")))  # one conversation's turns
    return turns.groupBy("conv_id").agg(F.transform(of, lambda t: F.struct(t["id"], t["words"])).alias("seq"))


def rebuilt(seqs: DataFrame, block: int = 20, borrow: int = 4) -> DataFrame:
    """Each conversation with its first h turns replaced by those of its block's first, h = crc32(conv_id) % ``borrow``.

    Blocks of negative ids follow SQL's remainder: -3 borrows from 0."""
    lead = seqs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("lead"), F.slice("seq", 1, borrow - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrow
    rows = seqs.select("conv_id", "seq", (F.col("conv_id") - F.col("conv_id") % block).alias("lead"), h.cast("int").alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(SEQ))
    own = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return rows.join(lead, "lead", "left").select("conv_id", F.concat(head, own).alias("seq"))


def classes(seqs: DataFrame) -> DataFrame:
    """cls (smallest conv_id), convs (how many) and seq of each distinct sequence."""
    key = F.transform("seq", lambda t: t["id"])
    return seqs.groupBy(key.alias("ids")).agg(F.min("conv_id").alias("cls"), F.count("*").alias("convs"), F.first("seq").alias("seq")).drop("ids")


def end_digests(seqs: DataFrame, classed: DataFrame, piece: int = PIECE) -> DataFrame:
    """cls and ends_sha256: the digest of the class's conv_ids, ascending and joined by commas."""
    ids = lambda: F.transform("seq", lambda t: t["id"])
    of = seqs.select("conv_id", ids().alias("ids")).join(classed.select("cls", "convs", ids().alias("ids")), "ids")
    alone = of.where("convs = 1").select("cls", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else []
            cuts = np.unique(np.concatenate([np.arange(a, b, piece) for a, b in zip(cuts, np.r_[cuts[1:], len(cls)])])) if len(cls) else []
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.r_[cuts[1:], len(cls)])] if len(cls) else []
            yield pa.RecordBatch.from_arrays([pa.array(cls[cuts] if len(cls) else [], pa.int64()), pa.array(conv[cuts] if len(cls) else [], pa.int64()), pa.array(texts, pa.string())], names=["cls", "at", "part"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for cls, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                if cls != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = cls, hashlib.sha256(part.as_py().encode())
                else:
                    state.update(b"," + part.as_py().encode())
            yield pa.RecordBatch.from_pydict({"cls": pa.array([c for c, _ in done], pa.int64()), "ends_sha256": pa.array([d for _, d in done], pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"cls": pa.array([now], pa.int64()), "ends_sha256": pa.array([state.hexdigest()])})

    several = cut(of.where("convs > 1").select("cls", "conv_id"), "class-members")
    parts = several.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(pieces, "cls long, at long, part string")
    streamed = cut(parts, "id-pieces").repartition("cls").sortWithinPartitions("cls", "at").mapInArrow(digests, "cls long, ends_sha256 string")
    return alone.unionByName(streamed)


@dataclass
class Sorted:
    """Nodes of one bucket in the order in which they were made: parents before children."""

    depth: list[int]
    conv: list[int]
    parent: list[int]  # a place in these lists; -1 for the bucket's own node
    convs: list[int]
    own: list[int]  # (convs - 1) times the words of the node's last turn
    ends: list[int | None]

    def add(self, depth: int, conv: int, parent: int, convs: int, words: int) -> int:
        for column, value in zip((self.depth, self.conv, self.parent, self.convs, self.own, self.ends), (depth, conv, parent, convs, (convs - 1) * words, None)):
            column.append(value)
        return len(self.depth) - 1


def multikey_sort(ids: np.ndarray, words: np.ndarray, at: np.ndarray, sizes: np.ndarray, cls: np.ndarray, convs: np.ndarray, depth: int) -> Sorted:
    """Three-way radix quicksort of distinct sequences that share ``depth`` turns; sequence r is ``ids[at[r] : at[r] +
    sizes[r]]``. The middle part of each partition is a node."""
    made = Sorted([], [], [], [], [], [])
    rows = np.arange(len(at))
    work: list[tuple[bool, int, int, int, int]] = [(True, 0, len(rows), depth, -1)]  # a node to make, or a range to split
    while work:
        is_node, lo, hi, d, node = work.pop()
        mine = rows[lo:hi]
        if is_node:
            word = int(words[at[mine[0]] + d - 1]) if d else 0
            node = made.add(d, int(cls[mine].min()), node, int(convs[mine].sum()), word)
            if len(mine) == 1:  # what is left of a single sequence is a chain
                r = int(mine[0])
                for deeper in range(d, int(sizes[r])):
                    node = made.add(deeper + 1, int(cls[r]), node, int(convs[r]), int(words[at[r] + deeper]))
                made.ends[node] = int(cls[r])
                continue
            over = sizes[mine] == d
            if over.any():  # at most one, as sequences are distinct
                made.ends[node] = int(cls[mine[over]][0])
                rows[lo:hi] = np.concatenate((mine[over], mine[~over]))
                lo += int(over.sum())
            work.append((False, lo, hi, d, node))
        elif lo < hi:
            digits = ids[at[mine] + d]
            pivot = np.partition(digits[[0, len(digits) // 2, -1]], 1)[1]
            less, more = digits < pivot, digits > pivot
            same = ~(less | more)
            rows[lo:hi] = np.concatenate((mine[less], mine[same], mine[more]))
            a, b = lo + int(less.sum()), hi - int(more.sum())
            work += [(False, lo, a, d, node), (True, a, b, d + 1, node), (False, b, hi, d, node)]
    return made


def local_nodes(buckets: DataFrame) -> DataFrame:
    """All nodes of small buckets. ``buckets`` has bucket, up (the bucket above), up_conv (its node's conv_id), depth, cls,
    convs and seq; the rows of a bucket's own node keep bucket and up."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            last = int(np.searchsorted(number, number[-1]))  # where the bucket that may go on begins
            if last or (held and held[0].column(0)[-1].as_py() != number[-1]):
                yield from tries(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from tries(pa.Table.from_batches(held))

    def tries(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        number = rows["bucket"].to_numpy()
        seqs = rows["seq"].chunk(0)
        turns = seqs.flatten()
        ids, words = turns.field("id").to_numpy(), turns.field("words").to_numpy()
        sizes = np.diff(seqs.offsets.to_numpy()).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        cls, convs, depth = (rows[c].to_numpy() for c in ("cls", "convs", "depth"))
        up, up_conv = rows["up"].to_pylist(), rows["up_conv"].to_pylist()
        out: list[list] = [[] for _ in range(10)]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(number)]):
            made = multikey_sort(ids, words, at[a:b], sizes[a:b], cls[a:b], convs[a:b], int(depth[a]))
            size = len(made.depth)
            children, leaves, saved = [0] * size, [0] * size, made.own[:]
            for k in range(size - 1, -1, -1):
                leaves[k] = leaves[k] or 1
                if (p := made.parent[k]) >= 0:
                    children[p] += 1
                    leaves[p] += leaves[k]
                    saved[p] += saved[k]
            parents = [made.conv[p] if p >= 0 else up_conv[a] for p in made.parent]
            blank = [None] * (size - 1)
            for column, values in zip(out, (made.conv, made.depth, parents, made.convs, children, leaves, saved, made.ends, [int(number[a]), *blank], [up[a], *blank])):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in f"{NODE}, bucket long, up long".split(", ")])

    rows = buckets.select("bucket", "up", "up_conv", "depth", "cls", "convs", "seq")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(of, f"{NODE}, bucket long, up long")


def common(a: Column, b: Column) -> Column:
    """How many turns two sequences share from the first on."""
    least = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: F.get(a, i - 1)["id"] != F.get(b, i - 1)["id"])
    return F.when(least > 0, F.coalesce(F.array_min(differ) - 1, least)).otherwise(0)


def split(active: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step over large buckets: the buckets themselves (with the run of nodes that each begins with), and the rows of
    their parts, small and large."""
    of = active.groupBy("bucket", "up", "up_conv", "depth").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.min("cls").alias("conv_id"), F.sum("convs").alias("n_convs"), F.min(F.struct(F.size("seq").alias("n"), "cls")).alias("short"),
    )
    of = of.withColumn("deep", common(F.col("low"), F.col("high")))
    ends = F.when(F.col("short.n") == F.col("deep"), F.col("short.cls"))
    words = F.transform(F.slice("low", 1, F.col("deep")), lambda t: t["words"])
    large = cut(of.select("bucket", "up", "up_conv", "depth", "deep", "conv_id", "n_convs", ends.alias("ends"), words.alias("words")), "large-buckets")
    heads = large.select("bucket", "deep", F.col("conv_id").alias("new_up_conv"))
    left = active.select("bucket", "cls", "convs", "seq").join(heads, "bucket").where(F.size("seq") > F.col("deep"))
    left = left.withColumn("next", F.get("seq", F.col("deep"))["id"])
    parts = left.groupBy("bucket", "next").agg(F.sum(F.size("seq") - F.col("deep")).alias("turns"))
    parts = cut(parts.select("bucket", "next", (F.col("turns") <= local).alias("small"), F.monotonically_increasing_id().alias("new")), "parts")
    rows = cut(
        left.join(parts, ["bucket", "next"]).select(F.col("new").alias("bucket"), F.col("bucket").alias("up"), F.col("new_up_conv").alias("up_conv"), (F.col("deep") + 1).cast("long").alias("depth"), "cls", "convs", "seq", "small"),
        "bucket-rows",
    )
    return large, rows.where("small").drop("small"), rows.where("NOT small").drop("small")


def run_nodes(large: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of large buckets, from their own depth to where they part. ``below`` has up, leaves, saved and children."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in f"{NODE}, bucket long, up long".split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                depths = np.arange(row["depth"], row["deep"] + 1)
                own = (row["n_convs"] - 1) * np.array([0, *row["words"]], np.int64)[depths]
                size, bottom = len(depths), np.arange(len(depths)) == len(depths) - 1
                saved = np.cumsum(own[::-1])[::-1] + row["saved"]
                same = lambda v: pa.array([v] * size, pa.int64())
                only = lambda v, k: pa.array([v if i == k else None for i in range(size)], pa.int64())
                parents = pa.array([row["up_conv"], *[row["conv_id"]] * (size - 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    same(row["conv_id"]), pa.array(depths), parents, same(row["n_convs"]), pa.array(np.where(bottom, row["children"], 1)), same(row["leaves"] or 1), pa.array(saved), only(row["ends"], size - 1),
                    only(row["bucket"], 0), only(row["up"], 0),
                ], names=names)

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = large.join(below.withColumnRenamed("up", "bucket"), "bucket", "left").select("bucket", "up", "up_conv", "depth", "deep", "conv_id", "n_convs", "ends", "words", *map(zero, ("leaves", "saved", "children")))
    return rows.mapInArrow(of, f"{NODE}, bucket long, up long")


def trie(classed: DataFrame, local: int = LOCAL) -> DataFrame:
    """Every node of the trie over ``classed`` (cls, convs, seq): the columns of ``NODE``, where ``ends`` is the class that
    ends at the node."""
    nothing = F.lit(None).cast("long")
    active = classed.select(F.lit(0).cast("long").alias("bucket"), nothing.alias("up"), nothing.alias("up_conv"), F.lit(0).cast("long").alias("depth"), "cls", "convs", "seq")
    levels: list[tuple[DataFrame, DataFrame]] = []
    total = classed.agg(F.sum(F.size("seq"))).first()[0] or 0
    smalls = None if total > local else active
    while smalls is None or levels and active.take(1):
        large, small, active = split(active, local)
        levels.append((large, small))
        smalls = small
    made = [cut(local_nodes(small), "local-nodes") for _, small in levels] or [cut(local_nodes(smalls), "local-nodes")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        tops = made[k].where("bucket IS NOT NULL")
        tops = tops if above is None else tops.unionByName(above.where("bucket IS NOT NULL"))
        below = tops.groupBy("up").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
        above = cut(run_nodes(levels[k][0], below), "run-nodes")
        made.append(above)
    nodes = made[0]
    for other in made[1:]:
        nodes = nodes.unionByName(other)
    return nodes.drop("bucket", "up")


def prefix_trie(conversations: DataFrame, rebuild: bool = True, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    With ``rebuild`` conversations are first given the leading turns of their block (see ``rebuilt``).
    """
    seqs = sequences(numbered(cut(ordered_turns(conversations), "turns")))
    seqs = cut(rebuilt(cut(seqs, "own-sequences")) if rebuild else seqs, "sequences")
    classed = cut(classes(seqs), "classes")
    ends = end_digests(seqs, classed).withColumnRenamed("cls", "ends")
    empty = hashlib.sha256(b"").hexdigest()
    return trie(classed, local).join(ends, "ends", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
