import hashlib
import random
import re

import numpy as np
import pytest

from leadflow.llm import components, near_dedup, suffix_dedup, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rng, n, size, edits, first):
    """Copies of copies: similarities spread around the threshold."""
    texts = [[f"w{rng.randrange(10 ** 6)}" for _ in range(size)]]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
        texts.append(t)
    return [(first + i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dedup_equals_brute_force(spark, docs):
    rng = random.Random(5)
    rows = family(rng, 60, 120, 4, 100) + family(rng, 40, 30, 1, 300) + family(rng, 25, 9, 1, 500)
    rows += [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "Two  WORDS"), (6, "É x y z w"), (7, "é x y z w"),
             (8, "x " * 30000), (9, "x " * 4), (10, "x " * 9)]
    out = near_dedup.near_classes(docs([(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_edges(spark, docs):
    out = near_dedup.near_classes(docs([(None, "a b c d e f", "s"), (3, "a b c d e f", None), (3, "a b c d e f", "s"),
                                        (2, "A b c d e\tf", "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out if r.doc_id) == [(2, 2, True), (3, 2, False), (3, 2, False)]
    assert [r.kept for r in out if r.doc_id is None] == [True]
    assert near_dedup.near_classes(docs([(1, "a", "s")]).limit(0)).count() == 0
    kept = near_dedup.keep_one(docs([(5, "a b c", "s"), (6, "a b c", "t"), (7, None, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7] and "row_id" in kept.columns


def test_blocks_join_what_stars_leave_apart(spark):
    sets = [np.arange(k, k + 100, dtype=np.int64) for k in range(0, 40, 5)]      # neighbours share 95 of 105
    comp = np.arange(len(sets))
    both = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    found = near_dedup._joining_links(np.concatenate([comp, comp]), np.repeat([0, 1], len(sets)), sets + sets, 85)
    assert len(found) == len(sets) - 1 and all((i, j - len(sets)) in both for i, j in found)


def test_components(spark):
    links = spark.createDataFrame([(9, 4), (4, 7), (1, 2), (2, 1), (20, 21), (21, 22), (22, 23), (23, 19)], "a long, b long")
    got = {r.id: r.comp for r in components.connected_components(links).collect()}
    assert got == {9: 4, 4: 4, 7: 4, 1: 1, 2: 1, 20: 19, 21: 19, 22: 19, 23: 19, 19: 19}
    assert components.connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    b = bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 80)).astype(np.uint8)) * int(rng.integers(1, 4))
    s = np.frombuffer(b, np.uint8)
    sa = suffixes.suffix_array(s)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    before, common = suffixes.permuted_common_prefixes(s, sa)
    for r in range(1, len(b)):
        i, j, n = sa[r], sa[r - 1], 0
        while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
            n += 1
        assert (before[i], common[i]) == (j, n)


def brute_removal(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in raw:
        for p in range(len(b) - 199):
            count[b[p:p + 200]] = count.get(b[p:p + 200], 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(9))
    text = lambda n: "".join(word() for _ in range(n))
    passage, line = text(30), text(15)[:120]
    rows = [(i, text(rng.randrange(1, 60)) + (passage if i % 3 == 0 else "") + line + text(rng.randrange(0, 30))) for i in range(40)]
    rows += [(100, passage[:200]), (101, passage[:199]), (102, "ab" * 400), (103, "a" * 250), (104, None), (105, ""),
             (106, rows[4][1]), (107, rows[4][1][5:]), (108, "\x00" * 300), (None, rows[7][1]), (6, rows[6][1]), (109, text(6000) + passage)]
    return rows


def test_suffix_dedup_equals_brute_force(spark, docs):
    rows = repeat_rows()
    got = [tuple(r) for r in suffix_dedup.removal_report(docs([(i, t, "s") for i, t in rows])).collect()]
    assert sorted(got, key=str) == brute_removal(rows)


def test_suffix_dedup_of_busy_grams(spark, docs, monkeypatch):
    """The exact way for grams in too many segments gives the same result."""
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", 1)
    rows = repeat_rows()
    got = [tuple(r) for r in suffix_dedup.removal_report(docs([(i, t, "s") for i, t in rows])).collect()]
    assert sorted(got, key=str) == brute_removal(rows)


def test_texts_without_repeats(spark, docs):
    long = "".join(chr(0x20 + (i * 7919) % 90) for i in range(260))
    assert suffix_dedup.removal_report(docs([(1, "a", "s")]).limit(0)).count() == 0
    out = suffix_dedup.without_repeats(docs([(1, "head " + long, "s"), (2, long + " tail", None), (3, None, "s"), (4, "short", "s")]))
    assert out.columns == docs([(1, "a", "s")]).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "head ", 2: " tail", 3: None, 4: "short"}
