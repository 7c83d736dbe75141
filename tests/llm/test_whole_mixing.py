"""Small sources reach their targets with production's block."""

import collections
import random

import numpy as np
import pytest

from contentlens.llm import mixing


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(6)
    rows = [(1000 * s + d, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(20, 150))), f"site{s:03}") for s in range(200) for d in range(rng.randint(1, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = {i: s for i, _, s in rows}
    got, target = collections.Counter(), {}
    for r in mixing.taken(df, block=128).collect():
        assert r.taken <= 3 * r.size
        got[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert len(target) == 200 and {s: got[s] for s in target} == {s: round(t) for s, t in target.items()}
    words = collections.Counter()
    for r in mixing.mixed_documents(df, block=128).collect():
        words[r.source] += len(r.text.split())
    assert words == got


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_unpermute(n):
    assert [mixing.unpermute(int(b), n, 9) for b in mixing.permute(np.arange(n), n, 9)] == list(range(n))
