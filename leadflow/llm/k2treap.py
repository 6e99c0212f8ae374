"""A K2-treap: a compressed quadtree over a grid whose cells store maxima (numpy).

The grid has 2**side rows and columns. Only quadrants that hold a value exist.
Nodes are written level by level; a node has four bits, one per quadrant in the
order (upper left, upper right, lower left, lower right), and its children stand
in a row in the next level, where the bits set before them say. The largest
value of a quadrant is kept as its distance below its parent's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

_BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)
_HEAD = np.dtype("<i8")


def _spread(x: np.ndarray) -> np.ndarray:
    """Moves bit i of 32 to bit 2i."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


@dataclass
class Treap:
    side: int               # levels below the root
    kids: np.ndarray        # uint8 per node: which quadrants exist
    first: np.ndarray       # int32 per node: its first child
    top: np.ndarray         # int64 per node: the largest value below it

    @classmethod
    def build(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, size: int) -> bytes:
        """The written treap of distinct cells; ``size`` bounds rows and columns."""
        side = max(1, int(size - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(cols)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int64)
        tops, kids, parent = [top], [], []
        for _ in range(side):
            up = code >> np.uint64(2)
            new = np.concatenate(([True], up[1:] != up[:-1]))
            at = np.flatnonzero(new)
            kids.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8), at))
            parent.append(np.cumsum(new) - 1)
            top = np.maximum.reduceat(top, at)
            tops.append(top)
            code = up[at]
        below = [tops[-1], *[tops[k + 1][parent[k]] - tops[k] for k in range(side - 1, -1, -1)]]
        head = np.array([side, *[len(t) for t in reversed(tops)]], _HEAD)
        below = np.concatenate(below).astype("<u4").view(np.uint8).reshape(-1, 4).T
        raw = head.tobytes() + np.concatenate(kids[::-1]).tobytes() + np.ascontiguousarray(below).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def read(cls, written: bytes) -> "Treap":
        raw = zstandard.ZstdDecompressor().decompress(written)
        side = int(np.frombuffer(raw, _HEAD, 1)[0])
        sizes = np.frombuffer(raw, _HEAD, side + 1, 8)
        n, inner = int(sizes.sum()), int(sizes[:-1].sum())
        at = 8 * (side + 2)
        kids = np.zeros(n, np.uint8)
        kids[:inner] = np.frombuffer(raw, np.uint8, inner, at)
        below = np.frombuffer(raw, np.uint8, 4 * n, at + inner).reshape(4, n)
        below = np.ascontiguousarray(below.T).view("<u4").reshape(-1).astype(np.int64)
        count = _BITS[kids]
        first = (1 + np.cumsum(count) - count).astype(np.int32)   # the root is 0, every other node a child
        top = below
        start = np.concatenate(([0], np.cumsum(sizes)))
        for k in range(side):
            up = np.repeat(np.arange(start[k], start[k + 1]), count[start[k]:start[k + 1]])
            here = slice(start[k + 1], start[k + 2])
            top[here] = top[up] - top[here]
        return cls(side, kids, first, top)

    def best_columns(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 0, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores (weights times the rows' values, summed) that can be
        among the ``k`` best above 0: all with at least the k-th score and ``floor``.

        The rows' paths descend together over ranges of columns. A range's bound
        is the weighted sum of the maxima of the quadrants its rows lie in; the
        ranges of the largest bounds are halved first, and a range under the k-th
        score found is never looked at.
        """
        rows, weights = rows.astype(np.int64), weights.astype(np.int64)
        nodes = np.zeros((1, len(rows)), np.int32)
        bound = np.array([int(weights.sum()) * int(self.top[0])])
        level, low = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        best = np.zeros(0, np.int64)
        floor = max(1, floor)
        while len(bound):
            if len(bound) > batch:
                pick = np.zeros(len(bound), bool)
                pick[np.argpartition(-bound, batch)[:batch]] = True
            else:
                pick = np.ones(len(bound), bool)
            nd, bd, lv, lo = nodes[pick], bound[pick], level[pick], low[pick]
            leaf = lv == self.side
            if leaf.any():
                cols.append(lo[leaf])
                scores.append(bd[leaf])
                best = np.concatenate([best, bd[leaf]])
                if len(best) >= k:
                    best = np.partition(best, len(best) - k)[len(best) - k:]
                    floor = max(floor, int(best.min()))
            inner = ~leaf
            nd, lv, lo = nd[inner], lv[inner], lo[inner]
            new = [(nodes[~pick], bound[~pick], level[~pick], low[~pick])]
            if len(nd):
                alive = np.maximum(nd, 0)
                kids, start = self.kids[alive], self.first[alive]
                down = (self.side - 1 - lv)[:, None]
                row_bit = (rows[None, :] >> down) & 1
                for half in (0, 1):
                    quadrant = (2 * row_bit + half).astype(np.uint8)
                    there = (nd >= 0) & ((kids >> quadrant) & 1).astype(bool)
                    child = np.where(there, start + _BITS[kids & (np.left_shift(np.uint8(1), quadrant) - np.uint8(1))], -1).astype(np.int32)
                    b = np.where(there, self.top[np.maximum(child, 0)], 0) @ weights
                    new.append((child, b, lv + 1, lo + (half << down[:, 0])))
            nodes, bound, level, low = (np.concatenate(x) for x in zip(*new))
            ok = bound >= floor
            if not ok.all():
                nodes, bound, level, low = nodes[ok], bound[ok], level[ok], low[ok]
        cols, scores = np.concatenate(cols), np.concatenate(scores)
        ok = scores >= floor
        return cols[ok], scores[ok]
