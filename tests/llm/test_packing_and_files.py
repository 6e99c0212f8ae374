import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm import packing, planefile, token_output
from leadflow.llm import textops as T
from leadflow.llm.encoder import Encoder, vocabulary
from leadflow.session import scratch_path

TEXTS = ["", None, "plain words here", "x  y\n\nz   q　 w <|endoftext|> it's  ", "\n", "tab\t x", "é ́x ß ẞ",
         " lead", "a b" * 3000, "same text", "same text", "1234567 !!?? ...\r\n\x1c done"]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    encoder = Encoder.of(vocabulary(name))
    texts = [t or "" for t in TEXTS] * 3
    buf, offsets = T.column_bytes(pa.array(texts))
    ids, at = encoder.encode(buf, offsets)
    whole = library(name)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_and_packing(spark, docs):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "same id", "s")]
    out = packing.pack(packing.token_pieces(docs(rows), vocabulary(packing.VOCABULARY), 16), 16).toPandas()
    whole = library(packing.VOCABULARY)
    expected = []
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for p, lo in enumerate(range(0, len(ids), 16)):
            part = np.array(ids[lo:lo + 16], "<u4")
            expected.append((-1 if i is None else i, p, lo, len(part), zlib.crc32(part.tobytes())))
    got = out.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int)
    assert sorted(map(tuple, got.values.tolist())) == sorted(expected)
    for _, bin_ in out.groupby("sequence_id"):
        places = sorted(zip(bin_.offset, bin_.length))
        assert [p for p, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert bin_.length.sum() <= 16


def test_plan_replaces_the_smallest_by_two():
    counts = np.zeros(11, int)
    for n in (6, 3, 2, 2):
        counts[n] += 1
    # greedy: 6 + 3, gap 1; instead of 3, 2 + 2 fills the sequence
    places = packing.plan(counts, 10)
    assert int(places["sequences"][0]) == 2
    first = {(int(n), int(t)) for n, t, b in zip(places["length"], places["t"], places["base"]) if b == 0}
    assert first == {(6, 1), (2, 2)}
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 5000)
    assert packing.plan(np.bincount(sizes, minlength=101), 100)["sequences"][0] <= -(-sizes.sum() // 100) * 1.01


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None), (1, 5)], "doc_id long, n long")
    out = packing.pack(df, 8, "n", ("doc_id",)).collect()
    assert len(out) == 4 and {r.offset for r in out if not r.n} == {0}
    assert packing.pack(df.limit(0), 8, "n", ("doc_id",)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 4, "n", ("doc_id",))
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("offset", F.lit(1)), 8, "n", ("doc_id",))


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_round_trip(tmp_path, bits):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (0, 1, 70, 64, 5, 300)]
    w = planefile.Writer(f"file://{tmp_path}/a.planes", "t0", bits, block_ids=64)
    w.add([5, None, 7], [0, 1, 70], np.concatenate(sets[:3]))
    w.add([8, 9, 10], [64, 5, 300], np.concatenate(sets[3:]))
    w.close()
    r = planefile.Reader(str(tmp_path / "a.planes"))
    assert [(d, n, c) for d, n, c in r.documents()] == \
        [(d, len(s), zlib.crc32(s.tobytes())) for d, s in zip([5, None, 7, 8, 9, 10], sets)]
    assert np.concatenate(list(r.ids(60, 100))).tolist() == np.concatenate(sets)[60:160].tolist()
    assert [p.name for p in tmp_path.iterdir()] == ["a.planes"]


def test_token_output(spark, docs):
    rows = [(i * 10 % 7, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None)]
    files = token_output.write_token_files(docs(rows), scratch_path(spark, "t-planes"), vocabulary(token_output.VOCABULARY))
    out = sorted(token_output.read_token_files(files).collect(), key=lambda r: r.start)
    whole = library(token_output.VOCABULARY)
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert len(out) == len(rows)
    for got, (i, t, _) in zip(out, ordered):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    none = token_output.write_token_files(docs(rows).limit(0), scratch_path(spark, "t-none"), vocabulary(token_output.VOCABULARY))
    assert token_output.read_token_files(none).count() == 0
