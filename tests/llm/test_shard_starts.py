"""The repeated starts of one shard against counting every string."""

import random
from collections import Counter

import numpy as np

from leadflow.llm import suffix_dedup


def test_repeated_starts_against_counting(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDTH", 20)
    rng = random.Random(3)
    for _ in range(200):
        base = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 60))) for _ in range(6)]
        made = [(rng.choice(base)[rng.randrange(10):] + rng.choice(base))[:rng.randrange(20, 90)] for _ in range(rng.randrange(1, 9))]
        segments = [s for s in dict.fromkeys(made + base[:rng.randrange(3)]) if len(s) >= 20] or [b"x" * 25]
        twice = [rng.random() < 0.4 for _ in segments]
        seen = Counter()
        for s, t in zip(segments, twice):
            for i in range(len(s) - 19):
                seen[s[i:i + 20]] += 2 if t else 1
        want = {(k, i) for k, s in enumerate(segments) for i in range(len(s) - 19) if seen[s[i:i + 20]] > 1}
        owner, lo, hi = suffix_dedup.repeated_starts(segments, twice)
        assert {(int(k), i) for k, a, b in zip(owner, lo, hi) for i in range(a, b)} == want
        assert (np.diff(owner) >= 0).all()
