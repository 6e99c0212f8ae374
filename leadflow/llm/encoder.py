"""Token ids of whole texts, by the tokenizers library, each distinct piece once.

Both vocabularies cut a text into pre-tokens before merging, and a single
space or line feed between two visible characters always ends one. A text is
therefore cut there, every distinct piece is encoded by the library once per
worker and kept, and a text's ids are its pieces' ids in order. Where the
neighbour of a space could be white space beyond ASCII, nothing is cut.
Pieces are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from leadflow.llm import textops as T

#: Distinct pieces kept per worker before the memory is started afresh.
KEPT = 1_500_000
#: Bytes that may begin a white-space character beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_VISIBLE = np.ones(256, bool)
_VISIBLE[:0x21] = False
_VISIBLE[0x7F] = False


def vocabulary(name: str) -> str:
    """Path of one of the public vocabularies installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts. A piece after a space begins with
    that space; a line feed is a piece of its own."""
    n = len(buf)
    mark = np.zeros(n + 1, bool)
    mark[offsets[:-1]] = True
    if n > 2:
        at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
        at = at[(at > 0) & (at < n - 1)]
        before, after = buf[at - 1], buf[at + 1]
        ok = _VISIBLE[before] & _VISIBLE[after] & ~_WIDE[after]
        ok &= ~_WIDE[buf[np.maximum(at - 2, 0)]] & ~_WIDE[buf[np.maximum(at - 3, 0)]]
        inside = np.zeros(n + 1, bool)
        inside[offsets] = True
        at = at[ok & ~inside[at] & ~inside[at + 1]]
        mark[at] = True
        mark[at[buf[at] == 0x0A] + 1] = True
    return np.flatnonzero(mark[:n])


class Encoder:
    """Encodes batches of texts; one per worker and vocabulary."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._fresh()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _fresh(self) -> None:
        self.known = np.zeros(0, np.uint64)     # hashes of the kept pieces, ascending
        self.slot = np.zeros(0, np.int32)       # and each one's place in start and size
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, k: int, pieces: list[str]) -> None:
        """Keeps the pieces' ids in the places from k on."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        m = len(found)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < k + m:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[k:k + m] = self.used + np.cumsum(size) - size
        self.size[k:k + m] = size
        self.used += len(flat)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids)."""
        starts = cuts(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(buf))
        h = T.chunk_hash(buf, starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > KEPT:
            self._fresh()
        at = np.searchsorted(self.known, uniq)
        near = np.minimum(at, max(0, len(self.known) - 1))
        have = self.known[near] == uniq if len(self.known) else np.zeros(len(uniq), bool)
        place = np.where(have, self.slot[near], -1) if len(self.known) else np.full(len(uniq), -1)
        new = np.flatnonzero(~have)
        if len(new):
            k, raw = len(self.known), buf.tobytes()
            for lo in range(0, len(new), 20_000):
                here = first[new[lo:lo + 20_000]]
                self._add(k + lo, [raw[s:e].decode("utf-8", "replace")
                                   for s, e in zip(starts[here].tolist(), ends[here].tolist())])
            place[new] = k + np.arange(len(new))
            self.known = np.insert(self.known, at[new], uniq[new])
            self.slot = np.insert(self.slot, at[new], place[new])
        each = place[inverse]
        size = self.size[each].astype(np.int64)
        total = np.cumsum(size)
        out = self.ids[np.repeat(self.start[each] - (total - size), size) + np.arange(int(total[-1]))]
        upto = np.concatenate([[0], total])
        return out, upto[np.searchsorted(starts, offsets)]
