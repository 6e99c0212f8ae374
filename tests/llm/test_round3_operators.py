"""op11, op12, op13 against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from leadflow.llm import centroids, pivot_links, ranked_search
from leadflow.llm import textops as T
from leadflow.llm.k2treap import Treap

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def vectors(spark):
    """(rows) -> embeddings with columns whose names an operator might use itself."""
    def make(rows):
        data = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3.0) for i, v in rows]
        return spark.createDataFrame(data, "vec_id long, embedding array<double>, id int, comp int, n double")
    return make


# ------------------------------------------------------------ op11

def crowd(rng, n, width, spread, first):
    c = rng.normal(size=width)
    return [(first + i, (c + spread * rng.normal(size=width)).tolist()) for i in range(n)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    z = {k: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for k, (_, v) in enumerate(rows) if good(v)}
    near = {k: [j for j in z if j != k and len(z[j]) == len(z[k]) and z[j] @ z[k] >= 0.9] for k in z}
    comp = list(range(len(rows)))
    for k in z:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    out = []
    for k, (i, _) in enumerate(rows):
        c = comp[k] if k in z else i
        out.append((i, len(near.get(k, [])), c, i == c))
    return sorted(out, key=str)


def link_rows():
    rng = np.random.default_rng(3)
    rows = crowd(rng, 90, 24, 0.15, 1000) + crowd(rng, 60, 24, 0.32, 2000) + crowd(rng, 150, 24, 9.0, 3000)
    rows += crowd(rng, 12, 5, 0.1, 4000)
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0, None] * 12), (5, [float("nan")] * 24), (6, [float("inf")] * 24)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (8, [1e300 * x for x in rows[0][1]]), (9, [1e-300 * x for x in rows[90][1]])]
    return rows


@pytest.mark.parametrize("wide, block", [(None, 1024), (2, 16), (3, 40)])
def test_links_equal_brute_force(vectors, wide, block):
    rows = link_rows()
    got = [tuple(r) for r in pivot_links.link_report(vectors(rows), wide=wide, block=block).collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_links_of_null_ids_and_small_tables(vectors):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = {tuple(r) for r in pivot_links.link_report(vectors([(None, a), (5, a), (None, b)])).collect()}
    assert got == {(None, 1, 5, False), (5, 1, 5, True), (None, 0, None, True)}
    assert [tuple(r) for r in pivot_links.link_report(vectors([(4, a)])).collect()] == [(4, 0, 4, True)]
    assert [tuple(r) for r in pivot_links.link_report(vectors([(4, None)])).collect()] == [(4, 0, 4, True)]
    assert pivot_links.link_report(vectors([(4, a)]).limit(0)).count() == 0


def test_lists_own_every_candidate_once():
    rng = np.random.default_rng(5)
    z = pivot_links.directions(rng.normal(size=(60, 8)))
    known = pivot_links.directions(rng.normal(size=(40, 8)))
    p = np.argsort(-(z @ known.T), axis=1)[:, :16]
    for wide in (1, 2, 3):
        times = np.zeros((60, 60), int)
        posts = {}
        for k, own in enumerate(p):
            low = np.sort(own)[:16 - 3 + wide]
            from itertools import combinations
            for names in combinations(low.tolist(), wide):
                posts.setdefault(names, []).append(k)
        for names, who in posts.items():
            ok = pivot_links.compare_blocks(z[who], z[who], p[who], p[who], True, names[-1], wide, 3, -2.0)
            for x, y in zip(*np.nonzero(ok)):
                times[who[x], who[y]] += 1
        want = np.array([[len(set(a) & set(b)) >= 3 for b in p.tolist()] for a in p.tolist()])
        assert ((times + times.T)[~np.eye(60, dtype=bool)] == want[~np.eye(60, dtype=bool)]).all()


def test_wider_lists_at_larger_tables():
    assert [pivot_links.width_of_lists(n, 4096, 3) for n in (1000, 10 ** 6, 10 ** 8, 10 ** 12)] == [1, 1, 2, 3]


# ------------------------------------------------------------ op12

def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_search(docs, items, k=50):
    terms = [TERM.findall(lower(t or "")) for _, t in docs]
    n, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        asked = set(TERM.findall(lower(text or "")))
        found = []
        for (i, _), t in zip(docs, terms):
            if not t:
                continue
            m = 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * t.count(w)) // (1000 * t.count(w) + 20 * m))
                    for w in asked if w in df)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_tables(seed):
    rng = random.Random(seed)
    names = [f"t{rng.randrange(60)}" if rng.random() < 0.7 else f"Rare{rng.randrange(900)}é" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(1, 80)))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 420)]                # a crowd of equal texts
    docs += [(420, None), (421, ""), (422, " .,; "), (423, "x" * 5000 + " t1"), (424, "t1 " * 4000), (7, docs[7][1]), (None, "t1 t2 t3")]
    items = [(k, " ".join(rng.choice(names) for _ in range(rng.randrange(1, 40)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "never-seen"), (23, docs[7][1]), (0, "t1, T1; t2"), (None, "t3")]
    return docs, items


@pytest.mark.parametrize("shard", [8 << 20, 1500])
def test_search_equals_brute_force(spark, docs, shard):
    rows, items = search_tables(11)
    asked = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, terms string")
    got = ranked_search.search(docs([(*r, "s") for r in rows]), asked, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, items)


def test_search_of_empty_tables(spark, docs):
    rows, items = search_tables(1)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(docs([(1, "a", "s")]).limit(0), asked).count() == 0
    assert ranked_search.search(docs([(1, None, "s"), (2, "..", "s")]), asked).count() == 0
    assert ranked_search.search(docs([(1, "t1", "s")]), asked.limit(0)).count() == 0


def test_items_in_several_blocks(spark):
    asked = spark.createDataFrame([(k, f"a{k} b c") for k in range(10)], "item_id long, text string")
    items = ranked_search.item_terms(asked)
    blocks = list(ranked_search.blocks_of(items, most=4))
    assert [len(b) for b in blocks] == [4, 4, 2] and sum(len(b) for b in ranked_search.blocks_of(items, terms=7)) == 10


@pytest.mark.parametrize("seed", range(20))
def test_treap_holds_every_cell(seed):
    rng = np.random.default_rng(seed)
    rows_n, cols_n = int(rng.integers(1, 40)), int(rng.integers(1, 70))
    cells = np.unique(rng.integers(0, rows_n * cols_n, int(rng.integers(1, 400))))
    r, c, v = cells // cols_n, cells % cols_n, rng.integers(0, 1 << 20, len(cells))
    grid = Treap.read(Treap.build(r, c, v, max(rows_n, cols_n)))
    full = np.zeros((rows_n, cols_n), np.int64)
    full[r, c] = v
    asked = rng.choice(rows_n, int(rng.integers(1, rows_n + 1)), replace=False)
    w = rng.integers(1, 50, len(asked))
    score = w @ full[asked]
    k = int(rng.integers(1, 10))
    cols, scores = grid.best_columns(asked, w, k, batch=3)
    assert (scores == score[cols]).all() and len(set(cols.tolist())) == len(cols)
    want = np.sort(score[score > 0])[::-1][:k]
    assert np.sort(scores)[::-1][:len(want)].tolist() == want.tolist()
    assert len(want) < k or set(np.flatnonzero(score >= want[-1]).tolist()) <= set(cols.tolist())


def test_terms_of_long_texts_are_cut_between_terms():
    text = ("lang " * 50 + "y" * 700 + " kurz ") * 5
    buf, offsets = T.column_bytes(__import__("pyarrow").array(["a b", text, "", "c"]))
    whole, small = ranked_search.term_counts(buf, offsets), ranked_search.term_counts(buf, offsets, 64)
    assert all((a == b).all() for a, b in zip(whole, small)) and int(whole[2].sum()) == 2 + 260 + 1


# ------------------------------------------------------------ op13

def brute_clusters(rows, count=16, rounds=3):
    x = [(i, [math.floor(64 * y) for y in v]) for i, v in rows
         if v is not None and len(v) == 64 and all(y is not None and math.isfinite(y) for y in v) and all(abs(64 * y) < 1 << 27 for y in v)]
    seeds = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cent = [v for _, v in seeds[:count]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent] for _, v in x]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        got = assign()
        for k in range(len(cent)):
            own = [v for (_, v), (c, _) in zip(x, got) if c == k]
            if own:
                cent[k] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    total = sum(d for _, d in got)
    return sorted(((i, c, d, sum(e for b, e in got if b == c), total, hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(x, got)), key=str)


def test_clusters_equal_brute_force(vectors):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.1, 1, 30])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(3, rows[4][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64),
             (306, [float("-inf")] * 64), (307, [1e200] * 64), (308, [0.0] * 64), (309, [2.0 ** 20] * 64)]
    got = centroids.cluster(vectors(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)


def test_few_and_no_vectors(vectors):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(rows)).collect()), key=str) == brute_clusters(rows)
    same = [(i, [0.5] * 64) for i in range(40)]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(same)).collect()), key=str) == brute_clusters(same)
    assert centroids.cluster(vectors(rows).limit(0)).count() == 0
    assert centroids.cluster(vectors([(1, None)])).count() == 0


# ------------------------------------------------------------ hashing

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_spans_that_a_polynomial_confuses():
    s = thue_morse(1024)
    for a, b in ((s, s.translate(str.maketrans("ab", "ba"))), ("a", "a\0"), ("", "\0"), ("x" * 64, "x" * 65)):
        both = np.frombuffer((a + b).encode(), np.uint8)
        h = T.chunk_hash(both, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]))
        assert h[0] != h[1]
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    buf = np.frombuffer("".join(parts).encode(), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    h = T.chunk_hash(buf, end - [len(p) for p in parts], end).tolist()
    assert len(set(zip(h, parts))) == len(set(h)) == len(set(parts))
