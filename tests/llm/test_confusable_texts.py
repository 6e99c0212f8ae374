"""Texts that a polynomial hash modulo 2**64 cannot tell apart, alone and inside
a text, through every operator that names spans by a hash; and near-dedup on
chains and very long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from leadflow.llm import encoder, merkle, near_dedup, packing
from leadflow.llm import textops as T
from tests.llm.test_dedup import brute_components
from tests.llm.test_round3_operators import thue_morse

A = thue_morse(1024)
B = A.translate(str.maketrans("ab", "ba"))
ROWS = [(1, A), (2, B), (3, "x " + A + " y"), (4, "x " + B + " y"), (5, f"eins zwei {A} drei vier fünf"), (6, f"eins zwei {B} drei vier fünf")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    from tokenizers import Tokenizer
    path = encoder.vocabulary(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    buf, offsets = T.column_bytes(pa.array([t for _, t in ROWS]))
    ids, upto = encoder.Encoder.of(path).encode(buf, offsets)
    for k, (_, t) in enumerate(ROWS):
        assert ids[upto[k]:upto[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_packed_and_written_ids_differ(spark, docs):
    rows = docs([(*r, "s") for r in ROWS])
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(spark, rows).collect()}
    assert packed[1] != packed[2] and packed[3] != packed[4] and packed[5] != packed[6]


def test_near_dedup_links_none_of_them(spark, docs):
    out = near_dedup.near_classes(docs([(*r, "s") for r in ROWS])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(ROWS)
    assert all(r.kept for r in out)


def test_merkle_roots_differ():
    marks = merkle.fingerprints([t for _, t in ROWS] + [A])
    assert len({m[:32] for m in marks}) == len(ROWS) and marks[0] == marks[-1]
    assert merkle.likeness(marks[0], marks[1]) < 1 and merkle.edits(marks[2], marks[3])


def test_chain_family_equals_brute_force(spark, docs):
    """Copies of the last copy: neighbours are linked, ends are not."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(words)
        words[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(words)))
    out = near_dedup.near_classes(docs([(*r, "s") for r in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_long_texts_in_small_blocks(spark, docs):
    rng = random.Random(9)
    long = [f"u{rng.randrange(10 ** 7)}" for _ in range(100_000)]
    near = list(long)
    for _ in range(900):
        near[rng.randrange(len(near))] = "zz"
    far = list(long)
    for _ in range(9_000):
        far[rng.randrange(len(far))] = "zz"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(long[:50_000]))]
    out = near_dedup.near_classes(docs([(*r, "s") for r in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


@pytest.mark.parametrize("block", [1, 500, 1 << 16])
def test_blocks_of_any_size_find_the_same_links(spark, block):
    sets = {k: np.arange(k, k + 100) for k in range(0, 60, 5)}
    known = spark.createDataFrame([(k, s.tolist()) for k, s in sets.items()], "id long, shingles array<long>")
    open_ = spark.createDataFrame([(7, k, 100, k, 0, 0, len(sets), 100 * len(sets)) for k in sets],
                                  "key long, id long, n long, comp long, centre long, centre_comp long, members long, shingle_sum long")
    got = near_dedup.links_between(open_, known, 85, block).collect()
    assert {tuple(sorted(r)) for r in got} >= {(k, k + 5) for k in range(0, 55, 5)} and all(r.b - r.a <= 5 for r in got)


def test_shared_counts():
    rng = np.random.default_rng(4)
    a = [np.unique(rng.integers(0, 9000, n)) for n in (5, 4000, 1)]
    b = [np.unique(rng.integers(0, 9000, n)) for n in (3000, 2)]
    assert near_dedup._shared_counts(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
    assert near_dedup._shared_counts([np.array([1])], [np.array([2])]).tolist() == [[0]]
