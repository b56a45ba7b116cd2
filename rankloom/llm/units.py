"""Token ids of whole texts through a cache of space-delimited units.

Tokenizers of the byte-level and of the marker kind never merge across a space that stands between two characters
that are not white space. A text is cut there, a unit that the cache lacks goes through the tokenizer library, and the
ids of a text are its units' ids in a row. Where a space touches other white space the neighbours stay one unit.
Byte-level tokenizers also part a single line feed and a mark after letters from what stands beside them.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encode = Callable[[list[str]], list[list[int]]]


#: The space as tokenizers of the marker kind write it. Texts that hold it aren't cut.
MARKER = "\u2581"
#: Letters below are in the same classes for all versions of Unicode that matter.
LATIN = "\u0250"


def threaded(on: bool) -> None:
    """Whether the tokenizers library takes several threads for its next batches. Workers are shared by operators, so
    that each says it before each batch."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


def plain(part: str) -> bool:
    """Whether the text can be cut on both sides of this part."""
    return part != "" and part.strip() == part


def led(unit: str) -> str:
    """The unit with the space before it; a line feed stands for itself."""
    return unit if unit[0] == "\n" else " " + unit


def split_units(text: str, parted: bool = False) -> tuple[str, list[str]]:
    """The first unit, and the others without the space that leads them. With ``parted`` a single line feed begins a unit too."""
    if MARKER in text:
        return text, []
    parts = (text.replace("\n", " \n") if parted else text).split(" ")
    units: list[list[str]] = [[parts[0]]]
    sound = parts[0] != "" and not parts[0][-1].isspace()
    for p in parts[1:]:
        fed = parted and p[:1] == "\n"  # the space before it is not the text's
        body = p[1:] if fed else p
        if sound and body and not body[0].isspace():
            units.append([p])
        else:
            units[-1].append(p if fed else " " + p)
        sound = p != "" and not p[-1].isspace()
    first, *rest = map("".join, units)
    return first, rest


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``encode`` gives the ids of each of a list of strings; ``leads[i]`` tells whether token i begins with the space or
    its marker, by which the ids of many units that were encoded as one string are told apart. ``verify`` is called with
    strings and the ids found for them, once for each time they are encoded. ``head`` leads the first unit of a text.
    A unit enters the cache when it comes up in a second call, so that words seen once don't crowd it. With ``parted``
    single line feeds begin units of their own, and a full stop or comma after letters is looked up apart.
    """

    def __init__(self, encode: Encode, leads: np.ndarray, most: int = 400_000, longest: int = 64, verify: Callable[[list[str], list[bytes]], None] | None = None, head: str = "", parted: bool = False):
        self.encode, self.leads, self.most, self.longest, self.verify, self.head = encode, leads, most, longest, verify, head
        self.parted, self.tails = parted, dict(zip(".,", self._alone([".", ","]))) if parted else {}
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.seen, self.marked = bytearray(1 << 22), 0

    def _apart(self, units: list[str], run: int = 2048) -> list[bytes]:
        """Ids of each unit, whole runs of them encoded at once."""
        runs = [units[k : k + run] for k in range(0, len(units), run)]
        found: list[bytes] = []
        for part, got in zip(runs, self.encode(["".join(map(led, part)) for part in runs]) if runs else []):
            ids = np.array(got, dtype="<u4")
            at = np.flatnonzero(self.leads[ids])
            if len(at) != len(part) or at[0]:  # a token holds a lead within a unit: take them one by one
                found += self._alone(list(map(led, part)))
            else:
                raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                found += [raw[a:b] for a, b in zip((4 * at).tolist(), ends)]
        return found

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.encode(texts)] if texts else []

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of these units, each with the space or line feed that leads it."""
        tailed = [u for u in units if u[-1] in self.tails and u[:-1].isalpha() and (u.isascii() or max(u) < LATIN)]
        if tailed:
            rest = dict.fromkeys(units)
            for u in tailed:
                del rest[u]
            rest.update((u[:-1], None) for u in tailed if u[:-1] not in self.known)
            units = list(rest)
        alone = [u for u in units if " " in u or (self.parted and "\n" in u[1:])]
        apart = set(alone)
        joined = [u for u in units if u not in apart] if alone else units
        found = self._apart(joined) + self._alone(list(map(led, alone)))
        if self.verify and units:
            self.verify([" " + u for u in joined + alone], found)
        learned = dict(zip(joined + alone, found))
        for u in tailed:
            learned[u] = (self.known[u[:-1]] if u[:-1] in self.known else learned[u[:-1]]) + self.tails[u[-1]]
        return learned

    def _admit(self, learned: dict[str, bytes]) -> None:
        """Keep what was learned before; a byte for each of some slots tells that, and sometimes wrongly, which is harmless."""
        seen, slots = self.seen, len(self.seen) - 1
        if self.marked > slots // 4:
            seen[:] = bytes(len(seen))
            self.marked = 0
        if len(self.known) > self.most:  # the units that came first are mostly the frequent ones
            self.known = dict(islice(self.known.items(), self.most // 2))
        known, longest, marked = self.known, self.longest, 0
        for unit, ids in learned.items():
            at = hash(unit) & slots
            if not seen[at]:
                seen[at] = 1
                marked += 1
            elif len(unit) <= longest:
                known[unit] = ids
        self.marked += marked

    def forget(self, units: set[str]) -> None:
        """Drop these units, each with the space that leads it, from the caches: they are encoded and verified each time."""
        for u in units:
            self.known.pop(u[1:], None)
            self.heads.pop(self.head + u[1:], None)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each distinct unit of all the texts is looked up once; Arrow parts the texts and puts the ids in place."""
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts] if self.parted else texts, pa.large_string()), " ")
        bounds, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        codes, units = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        starts, row_of = bounds[:-1], np.repeat(np.arange(len(texts)), np.diff(bounds))
        firsts = [units[k] for k in codes[starts].tolist()]
        codes[starts] = len(units) + np.arange(len(texts))  # a place of its own for the head of each text
        found: list[bytes | None] = list(map(self.known.get, units))
        used = np.bincount(codes, minlength=len(units))[: len(units)] > 0
        gaps = [k for k in np.flatnonzero(used).tolist() if found[k] is None]

        odd = np.zeros(len(units) + len(texts), dtype=bool)  # units and heads that don't stand for themselves
        odd[[k for k in gaps if not self._sound(units[k])]] = True
        odd[[len(units) + k for k, (first, n) in enumerate(zip(firsts, np.diff(bounds).tolist())) if MARKER in first or (n > 1 and not plain(first))]] = True
        rough: dict[int, list[str]] = {}  # texts that hold such units: their units, joined where need be
        if odd.any():
            for k in np.unique(row_of[odd[codes]]).tolist():
                firsts[k], rough[k] = split_units(texts[k], self.parted)
            inner = np.isin(row_of, list(rough))
            inner[starts] = False
            codes[inner] = len(units) + len(texts)  # the whole text is at its head's place
            used = np.bincount(codes, minlength=len(units))[: len(units)] > 0
            gaps = [k for k in gaps if used[k]]
        missing = dict.fromkeys(units[k] for k in gaps)
        joined: dict[str, None] = {}  # holds for a text alone
        for rest in rough.values():
            for u in rest:
                if u not in self.known and u not in missing:
                    (missing if self._sound(u) else joined)[u] = None
        learned = self._learn(list(missing))
        apart = self._learn(list(joined)) if joined else {}
        for k in gaps:
            found[k] = learned[units[k]]
        heads = self._heads([self.head + f for f in firsts])
        for k, rest in rough.items():
            heads[k] += b"".join([next(ids[u] for ids in (self.known, learned, apart) if u in ids) for u in rest])
        self._admit(learned)
        placed = pa.array([*(x or b"" for x in found), *heads, b""], pa.large_binary()).take(pa.array(codes))
        raw, at = placed.buffers()[2], np.frombuffer(placed.buffers()[1], "<i8")[bounds].tolist()
        ids = memoryview(raw) if raw else memoryview(b"")
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def _sound(self, unit: str) -> bool:
        """Whether the unit's ids are the same wherever it stands."""
        return " " not in unit and MARKER not in unit and plain(unit[1:] if self.parted and unit[:1] == "\n" else unit)

    def _heads(self, firsts: list[str]) -> list[bytes]:
        """The ids of the first units of texts."""
        if len(self.heads) > self.most // 10:
            self.heads.clear()
        new = [f for f in dict.fromkeys(firsts) if f not in self.heads]
        found = self._alone(new)
        if self.verify and new:
            self.verify(new, found)
        self.heads.update(zip(new, found))
        heads = [self.heads[f] for f in firsts]
        for f in new:
            if len(f) > self.longest:
                del self.heads[f]
        return heads


def in_slices(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts (null as empty) in runs of about ``size`` characters, each with the place where it begins."""
    begin, run, n = 0, [], 0
    for k, text in enumerate(texts):
        run.append(text or "")
        n += len(run[-1])
        if n >= size:
            yield begin, run
            begin, run, n = k + 1, [], 0
    if run:
        yield begin, run
