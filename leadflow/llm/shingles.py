"""Distinct word shingles of whole texts as 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from leadflow.llm import textops as T

WIDTH = 5
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text of a batch, A-Z in
    lower case. A text of fewer words than ``width`` has one: all its words."""
    buf = T.LOWER[buf]
    starts, ends = T.words(buf, offsets)
    count = T.counts_per_text(starts, offsets)
    word = T.chunk_hash(buf, starts, ends)
    n = len(word)
    if n >= width:
        whole = word[:n - width + 1].copy()
        for k in range(1, width):
            whole = whole * _STEP + word[k:n - width + 1 + k]
        whole = T.mix(whole)
    else:
        whole = np.zeros(0, np.uint64)
    at = 0
    for c in count.tolist():
        if c >= width:
            u = np.sort(whole[at:at + c - width + 1])
            yield u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in word[at:at + c]:
                    h = h * _STEP + w
            yield T.mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c
