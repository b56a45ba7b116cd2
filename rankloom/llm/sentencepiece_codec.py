"""SentencePiece encoding and decoding by the tokenizers library.

The model file, a protobuf message, is read field by field; normaliser, space marker, scores or merges and byte
fallback are rebuilt as a tokenizers pipeline and sent to the workers as JSON. Workers encode batches on two threads
each, or as many as ``threads`` says: set it to the cores that ``spark.task.cpus`` gives a task. Where the model allows it (no normaliser rules, no piece with the marker inside) texts are cut into units and
repeated units come from a cache. Parity is verified on the run: whatever is encoded is also encoded by the
sentencepiece library and decoded again, and each document tells whether all of it agreed.

Defined results: an empty table gives no rows; a null text gives null ids, n_tokens 0 and true checks; an empty text has no tokens; rows are encoded
one by one; further columns are ignored. Texts of any length are encoded and decoded whole, in the memory of a few times
their size.
"""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.units import MARKER, UnitEncoder, in_slices, split_units, threaded

#: Fixed values of the model format: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else None
            if size is None:
                size, at = varint(at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class SpModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    byte_fallback: bool

    @property
    def cuttable(self) -> bool:
        """Whether no piece can reach over the space before a word, and the normaliser leaves texts as they are."""
        inner = any(MARKER in p.lstrip(MARKER) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return not (inner or self.charsmap or self.remove_extra_whitespaces or any(k == USER_DEFINED for *_, k in self.pieces))


def parse(raw: bytes) -> SpModel:
    """The parts of a model file that encoding needs."""
    pieces, kind, fallback, charsmap, dummy, strip = [], UNIGRAM, False, b"", True, True
    for number, value in fields(raw):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            charsmap, dummy, strip = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return SpModel(pieces, kind, charsmap, dummy, strip, fallback)


def build(model: SpModel, prefix: bool | None = None) -> str:
    """The tokenizers pipeline of the model, as JSON. ``prefix``: whether a marker is put before the text."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: k for k, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        low = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0) - 10
        scores = [(p, s if kind in (NORMAL, USER_DEFINED, UNKNOWN, BYTE) else low) for p, s, kind in model.pieces]
        core = models.Unigram(scores, vocab.get(unknown), byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-s, k, vocab[p[:j]], vocab[p[j:]], p[:j], p[j:]) for k, (p, s) in enumerate(usable.items()) for j in range(1, len(p)) if p[:j] in usable and p[j:] in usable]
        core = models.BPE(vocab, [m[4:] for m in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} aren't supported")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARKER))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    if not any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    ends = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(ends + [decoders.Strip(" ", 1, 0)] * model.add_dummy_prefix)
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    return tok.to_str()


class Codec:
    """Encoder, decoder and checker of a worker."""

    def __init__(self, pipeline: str, core: str, raw: bytes, cuttable: bool, prefix: bool, threads: int, verify: bool):
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the first batch with threads comes; packing has none
        from tokenizers import Tokenizer

        self.whole, self.core, self.raw, self.bad = Tokenizer.from_str(pipeline), Tokenizer.from_str(core), raw, set()
        self.prefix = prefix
        check = self._verify if verify else None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)

        def encode(tok: Tokenizer) -> Callable[[list[str]], list[list[int]]]:
            def ids(texts: list[str]) -> list[list[int]]:
                threaded(threads > 1)
                return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

            return ids

        self.units = None
        if cuttable and prefix:
            leads = np.zeros(self.core.get_vocab_size(), dtype=bool)
            leads[[k for token, k in self.core.get_vocab().items() if token.startswith(MARKER)]] = True
            self.units = UnitEncoder(encode(self.core), leads, verify=check, head=" ")
        self.encode, self.check = encode(self.whole), check

    def _verify(self, units: list[str], found: list[bytes]) -> None:
        """Remember the units (each with a leading space) or texts that the two libraries treat unlike, or that don't come back."""
        texts = [u[1:] for u in units] if self.units else units
        ids = [np.frombuffer(x, "<u4").tolist() for x in found]
        want = self.other.encode(texts, num_threads=1)
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        lossless = self.units is not None
        self.bad.update(u for u, t, x, y, b in zip(units, texts, ids, want, back) if t and (x != y or lossless and b != t.replace(MARKER, " ")))

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether all of its units passed the checks."""
        if self.units:
            found = [x if t else b"" for t, x in zip(texts, self.units(texts))]
            fine = [True] * len(texts)
            if self.bad:
                cut = [split_units(t) for t in texts]
                fine = [not t or not any(" " + u in self.bad for u in (first, *rest)) for t, (first, rest) in zip(texts, cut)]
                self.units.forget(self.bad)
                self.bad.clear()
            return found, fine
        found = [np.array(x, dtype="<u4").tobytes() for x in self.encode(texts)]
        if self.check:
            self.check(texts, found)
        fine = [t not in self.bad for t in texts]
        self.bad.clear()
        return found, fine


@lru_cache(maxsize=2)
def codec(settings: str) -> Codec:
    s = json.loads(settings)
    return Codec(s["pipeline"], s["core"], base64.b64decode(s["raw"]), s["cuttable"], s["prefix"], s["threads"], s["verify"])


@lru_cache(maxsize=4)
def settings_of(raw: bytes, threads: int = 2, verify: bool = True) -> str:
    model = parse(raw)
    return json.dumps({"pipeline": build(model), "core": build(model, prefix=False), "raw": base64.b64encode(raw).decode(), "cuttable": model.cuttable, "prefix": model.add_dummy_prefix, "threads": threads, "verify": verify})


def decode_ids(run: Codec, ids: list[bytes]) -> list[str]:
    return run.whole.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


def encode(docs: DataFrame, raw: bytes, threads: int = 2, verify: bool = True, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (unsigned 32-bit, little-endian), checked (parity and round trip of
    its units). With ``decoded`` also the text that ``decode`` gives for the ids, by the same worker."""
    shared = docs.sparkSession.sparkContext.broadcast(settings_of(raw, threads, verify))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = codec(shared.value)
        for batch in batches:
            whole = batch.column(1).to_pylist()
            for begin, texts in in_slices(whole):
                ids, fine = run(texts)
                null = [whole[begin + k] is None for k in range(len(texts))]
                back = [pa.array([None if n else t for n, t in zip(null, decode_ids(run, ids))], pa.string())] if decoded else []
                back += [pa.array([n or t == x for n, t, x in zip(null, texts, back[0].to_pylist())], pa.bool_()) for _ in back]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([None if n else x for n, x in zip(null, ids)], pa.binary()), pa.array(fine, pa.bool_()), *back],
                    names=["doc_id", "n_tokens", "ids", "checked"] + ["decoded"] * decoded + ["round_trip"] * decoded,
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, "doc_id long, n_tokens long, ids binary, checked boolean" + ", decoded string, round_trip boolean" * decoded)


def decode(encoded: DataFrame, raw: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(settings_of(raw, verify=False))

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        found = decode_ids(codec(shared.value), [x if x is not None else b"" for x in column])
        return pd.Series([None if x is None else t for x, t in zip(column, found)], dtype=object)

    return encoded.withColumn(out_col, text(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, raw: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of whole documents: doc_id, n_tokens, ids, checked, decoded, and round_trip, whether that
    equals the text (of two nulls it does; a text that holds the marker comes back with spaces and doesn't)."""
    return encode(docs, raw, id_col=id_col, text_col=text_col, decoded=True)


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
