"""Encoding of whole texts through units that a tokenizer never joins.

A unit is a stretch of text at whose ends the tokenizer always cuts, so the ids of a text are
the ids of its units in a row. Words repeat a lot, so every unit is encoded by the library once
and then remembered. Texts for which the cuts are not certain go to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Memo:
    """Values of units; forgotten all at once when there are too many, so memory is bounded."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 1_000_000, longest: int = 200):
        self.encode, self.limit, self.longest, self.known = encode, limit, longest, {}

    def values(self, texts: list[list[str]]) -> list[list]:
        """The values of the units of every text. What is not known is encoded in one call for all texts."""
        found = [list(map(self.known.get, units)) for units in texts]
        open_ = [i for i, values in enumerate(found) if None in values]
        missing: set[str] = set()
        for i in open_:
            missing.update(compress(texts[i], [v is None for v in found[i]]))
        if not missing:
            return found
        asked = list(missing)
        new = dict(zip(asked, self.encode(asked)))
        for i in open_:
            found[i] = [new[u] if v is None else v for u, v in zip(texts[i], found[i])]
        if len(self.known) + len(new) > self.limit:
            self.known = {}
        if len(new) <= self.limit:
            self.known.update(new if max(map(len, asked)) <= self.longest else {u: v for u, v in new.items() if len(u) <= self.longest})
        return found


_WORKERS: dict = {}


def worker(key: tuple, make: Callable):
    """The object of a key, kept by the Python worker for later tasks until another key is asked for.

    Workers live through all stages of an application, so only one object is held at a time.
    """
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = make()
    return _WORKERS[key]


def release() -> None:
    """Let go of what an earlier stage left in this Python worker."""
    _WORKERS.clear()


def space_units(text: str) -> list[str]:
    """Units for byte-level BPE with its usual pre-split: a word with the one space before it.

    The pre-split always cuts before the last white space of a run when something else
    follows. Only those cuts at a space or a line feed are used; all else stays together.
    """
    units: list[str] = []
    pieces = text.replace("\n", " \n").split(" ")
    for i, p in enumerate(pieces):
        if p[:1] == "\n":
            if len(p) > 1 and not p[1].isspace() and i:
                units.append(p)
                continue
            follow = p
        elif p and not p[0].isspace():
            units.append(" " + p if i else p)
            continue
        else:
            follow = " " + p if i else p
        if units:
            units[-1] += follow
        else:
            units.append(follow)
    return units


# White space other than space and line feed, as Python and Unicode see it.
_ODD_SPACE = re.compile(r"[^\S \n]")


def plain_spaces(text: str) -> bool:
    """True if every piece between single spaces or line feeds is a unit of its own."""
    return not (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD_SPACE.search(text))


def byte_level_pieces(text: str) -> tuple[list[str], bool]:
    """Units of the text; when the flag is set, a space belongs in front of all that don't start with a line feed."""
    if plain_spaces(text):
        return text.replace("\n", " \n").split(" "), True
    return space_units(text), False


class ByteLevel:
    """Values of whole texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, value: Callable, special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added if special else []
        self.value = value
        self.memo = Memo(lambda units: [value(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)])
        self.spaced = Memo(lambda units: [value(e.ids) for e in self.tokenizer.encode_batch_fast([u if u[0] == "\n" else " " + u for u in units], add_special_tokens=False)])

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def values(self, texts: list[str]) -> list[list]:
        """For every text the values of its units, in order."""
        first: list[list[str]] = []
        rest: list[list[str]] = []
        for t in texts:
            if not t or any(s in t for s in self.added):
                first.append([])
                rest.append([])
                continue
            pieces, spaced = byte_level_pieces(t)
            # The first piece has no space before it.
            first.append(pieces[:1] if spaced else pieces)
            rest.append(pieces[1:] if spaced else [])
        return [a + b if a else [self.whole(t)] if t else [] for t, a, b in zip(texts, self.memo.values(first), self.spaced.values(rest))]


class Merges:
    """The merge list of a BPE file, applied to many words at a time.

    ``ids`` gives each word the ids that the library gives it, as bytes: of all neighbours, those with the
    earliest merge are joined first, the leftmost of equal ones, until none can be joined.
    """

    _NONE = 1 << 30

    def __init__(self, model: dict, alphabet: dict[int, str]):
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary[alphabet[b]] for b in range(256)])
        self.last = np.array([vocabulary[alphabet[b] + end] for b in range(256)])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.joined = np.array([vocabulary[a + b] for a, b in merges])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], self._NONE)

    def ids(self, words: list[bytes], kind: np.dtype) -> list[bytes]:
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == size)
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, size)
            ids = np.hstack([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]])
            ranks = np.hstack([self._ranks(ids[:, :-1], ids[:, 1:]), np.full((len(at), 1), self._NONE)])
            column, left = np.arange(size), np.full(len(at), size)
            while len(at):
                j = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(at)), j]
                go = rank < self._NONE
                done = np.flatnonzero(~go)
                raw_ids, row_bytes = ids[done].astype(kind).tobytes(), size * kind.itemsize
                for start, i, n in zip(range(0, len(raw_ids), row_bytes), at[done].tolist(), (left[done] * kind.itemsize).tolist()):
                    out[i] = raw_ids[start : start + n]
                at, ids, ranks, left, j, rank = at[go], ids[go], ranks[go], left[go] - 1, j[go], rank[go]
                row = np.arange(len(at))
                ids[row, j] = self.joined[rank]
                # All that stands behind the joined pair moves up by one.
                behind = column[:-1] > j[:, None]
                ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(column[:-1] >= j[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = self._NONE
                right = np.minimum(j + 1, size - 1)
                ranks[row, j] = np.where(j + 1 < left, self._ranks(ids[row, j], ids[row, right]), self._NONE)
                some = np.flatnonzero(j > 0)
                ranks[some, j[some] - 1] = self._ranks(ids[some, j[some] - 1], ids[some, j[some]])
        return out


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, then others in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return array("I", ids).tobytes()
