"""Packing and fingerprints against plain versions that go document by document."""

import hashlib
import random
import re
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pytest

from leadflow.llm import merkle, packing
from leadflow.llm import textops as T


# ------------------------------------------------------------ best-two-fit

def best_two_fit(sizes, capacity):
    """The documents of each sequence: filled greedily, then the smallest gives way to the pair that fits best."""
    left, out = sorted(sizes), []

    def largest(room):
        return bisect_right(left, room) - 1

    while left:
        own, gap = [], capacity
        while (i := largest(gap)) >= 0:
            own.append(left.pop(i))
            gap -= own[-1]
        while gap and own:
            small = min(own)
            best = (small,)
            for i in sorted({left.index(x) for x in set(left) if x < gap + small}):
                j = largest(gap + small - left[i])
                if j == i:
                    j -= 1
                if j >= 0 and left[i] + left[j] > best[0]:
                    best = (left[i] + left[j], left[i], left[j])
            if len(best) == 1:
                break
            own.remove(small)
            for x in best[1:]:
                left.remove(x)
                own.append(x)
            insort(left, small)
            gap += small - best[0]
        out.append(own)
    return out


def sequences(places):
    """The lengths in each sequence of a plan, and how many documents of each length it places."""
    rows = {}
    for n, first, t, base in zip(*[places[c].tolist() for c in ("length", "first", "t", "base")]):
        rows.setdefault(base, []).append((n, t))
    starts = sorted(rows) + [int(places["sequences"][0])]
    return [Counter(dict(rows[a])) for a, b in zip(starts, starts[1:]) for _ in range(b - a)]


@pytest.mark.parametrize("seed,high,capacity", [(1, 60, 100), (2, 100, 100), (3, 30, 64), (4, 50, 50), (5, 9, 20), (6, 200, 256)])
def test_plan_against_document_by_document(seed, high, capacity):
    rng = random.Random(seed)
    sizes = [min(capacity, 1 + int(rng.random() ** 2 * high)) for _ in range(600)]
    plain = best_two_fit(sizes, capacity)
    got = sequences(packing.plan(np.bincount(sizes, minlength=capacity + 1), capacity))
    assert sum(got, Counter()) == Counter(sizes) and all(sum(n * t for n, t in c.items()) <= capacity for c in got)
    assert got[0] == Counter(plain[0])      # the first sequence is filled by the same rule
    assert abs(len(got) - len(plain)) <= 1 and len(got) >= -(-sum(sizes) // capacity)


# ------------------------------------------------------------ Merkle trees

def digest(data):
    return hashlib.blake2b(data, digest_size=16)


def span(data):
    return int(T.chunk_hash(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def plain_tree(text):
    """(root, pieces of the text) by walking over its lines."""
    pieces, sections = [], [[]]
    for line in re.findall(rb"[^\n]*\n|[^\n]+", text.encode()):
        words = list(re.finditer(rb"[^\x20\x09-\x0D]+", line))
        cuts = [0] + [after.start() for word, after in zip(words, words[1:]) if span(word.group()) % merkle.PIECE_WORDS == 0] + [len(line)]
        # a word that ends a piece may be the line before's last: its cut falls before this line's first word
        own = [line[a:b] for a, b in zip(cuts, cuts[1:])]
        if words and words[0].start() and sections_end_in(pieces):
            own = [line[:words[0].start()], own[0][words[0].start():], *own[1:]]
        pieces += own
        sections[-1].append(line)
        total = sum(span(p) for p in own) % (1 << 64)
        if int(T.mix(np.array([total], np.uint64))[0]) % merkle.SECTION_PARAGRAPHS == 0:
            sections.append([])
    whole = [digest(b"".join(digest(p).digest() for p in s)).digest() for s in sections if s]
    return digest(b"".join(whole)).hexdigest(), Counter(span(p) & 0xFFFFFFFF for p in pieces)


def sections_end_in(pieces):
    """Whether the last word so far ends its piece."""
    for p in reversed(pieces):
        if words := re.findall(rb"[^\x20\x09-\x0D]+", p):
            return span(words[-1]) % merkle.PIECE_WORDS == 0
    return False


def texts():
    rng = random.Random(7)
    base = ["\n".join(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 25))) for _ in range(12)]
    cut = [t[:len(t) // 2] + " edited é " + t[len(t) // 2 + 9:] for t in base]
    return base + cut + ["", "\n", "\n\n", "  ", "one", " lead\n  indented line\n\tmore", "a\n" * 50, base[0], base[0] + "\n"]


def test_fingerprints_against_plain_trees():
    rows = texts()
    marks, plain = merkle.fingerprints(rows), [plain_tree(t) for t in rows]
    assert [m[:32] for m in marks] == [root for root, _ in plain]
    for a, (root, left) in zip(marks, plain):
        for b, (other, right) in zip(marks, plain):
            total = sum(left.values()) + sum(right.values())
            want = 1.0 if root == other else 2 * sum((left & right).values()) / total if total else 0.0
            assert merkle.likeness(a, b) == want
