"""The pipeline's stages, each against the brute-force version run on what the stage before kept."""

import random
from collections import Counter

import corpus_pipeline
from leadflow.llm import toxicity
from leadflow.llm.common import table
from leadflow.session import scratch_path
from tests.llm.test_dedup import brute_components, brute_removal, family
from tests.llm.test_packing_and_files import library
from tests.llm.test_scoring_and_search import brute_mix, corpus


def test_stages_against_brute_force(spark):
    rng = random.Random(9)
    sf = scratch_path(spark, "t-sf")
    rows = corpus(400)
    passage = " ".join(f"p{rng.randrange(10 ** 5)}" for _ in range(60))
    plain = [(1000 + i, t + (" " + passage if i % 4 == 0 else "")) for i, (_, t) in enumerate(family(rng, 30, 100, 5, 0))]
    docs = [(i, t, "en", rng.choice(["a", "a", "b", None]), len(t)) for i, t, _, _ in rows]
    docs += [(i, t, "en", "c", len(t)) for i, t in plain] + [(2000, None, None, "a", None), (2001, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = table(spark, sf, "documents")
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.select("doc_id", "text", "source").collect()]
        path = scratch_path(spark, f"t-{name}")
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert now.columns == columns
            kept = [tuple(r) for r in now.select("doc_id", "text", "source").collect()]
        if name == "toxicity":
            model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
            scores = toxicity.scored(table(spark, sf, "documents").select("doc_id", "text"), model).collect()
            assert {r[0] for r in kept} == {r.doc_id for r in scores if not r.predicted}
            assert 0 < len(before) - len(kept) < 80 and {2000, 2001} <= {r[0] for r in kept}
        elif name == "minhash_near_dedup":
            classes = brute_components([(i, t) for i, t, _ in before])
            assert {r[0] for r in kept} == {i for i, (_, c) in classes.items() if i == c}
            assert len(kept) < len(before)
        elif name == "suffix_array_dedup":
            size = {i: n - gone for i, n, gone, _, _ in brute_removal([(i, t) for i, t, _ in before])}
            assert {i: len((t or "").encode()) for i, t, _ in kept} == size
            assert sum(size.values()) < sum(len((t or "").encode()) for _, t, _ in before)
        elif name == "source_mixing":
            words = Counter()
            for i, t, _ in kept:
                words[i] += len(t.split())
            assert dict(words) == {i: n for i, _, _, _, n in brute_mix(before) if n}
    whole = library("word_bpe_49k.json")
    tokens = Counter({})
    for i, t, _ in kept:
        tokens[i] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    got, room = Counter(), Counter()
    for r in now.collect():
        got[r.doc_id] += r.length
        room[r.sequence_id] += r.length
    assert got == tokens and max(room.values()) <= 4096
    assert corpus_pipeline.run(spark, sf).count() == now.count()
