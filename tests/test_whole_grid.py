"""The weight grid against a loop over unrounded scores."""

import random

import pytest

from contentlens.operators import evaluation
from contentlens.plans import evaluation as plans
from contentlens.plans import registry

SF = "/root/testdata/sf0.001"
TS = [round(0.4 + i * 0.01, 2) for i in range(41)]


def loop(rows, vectors, thresholds):
    out = {}
    for w in vectors:
        s = [(w[0] * r[0] + w[1] * r[1] + w[2] * r[2], r[3]) for r in rows]
        for t in thresholds:
            tp, yes = sum(y for x, y in s if x > t), sum(x > t for x, _ in s)
            out[(*w, t)] = 2 * tp / max(yes + sum(y for _, y in s), 1)
    return out


def test_scores_are_not_rounded(spark):
    rng = random.Random(4)
    rows = [(0.4049, 0.1, 0.1, 1), (0.4049, 0.1, 0.1, 1), (0.4, 0.4, 0.4, 0)] + [(round(rng.random(), 4), round(rng.random(), 4), round(rng.random(), 4), rng.randrange(2)) for _ in range(60)]
    g = evaluation.grid_search(spark.createDataFrame(rows, "l1 double, l2 double, l3 double, y int"), ["l1", "l2", "l3"], "y", TS, step=4)
    got = {(r.w1, r.w2, r.w3, r.threshold): r.f1 for r in g.collect()}
    want = loop(rows, {k[:3] for k in got}, TS)
    assert len(got) == 15 * 41 and got == {k: pytest.approx(v) for k, v in want.items()}


def test_weight_grid_matches_a_loop(spark):
    rows = [(r.l1, r.l2, r.l3, r.y) for r in plans.scored(spark, SF).collect()]
    vectors = [(i / 20, j / 20, (20 - i - j) / 20) for i in range(21) for j in range(21 - i)]
    best = sorted(loop(rows, vectors, TS).items(), key=lambda kv: (-round(kv[1], 9), -kv[0][2], kv[0][0], kv[0][3]))[:10]
    got = sorted((r.w1, r.w2, r.w3, r.threshold, r.f1) for r in registry.QUERIES["weight_grid"](spark, SF).collect())
    assert got == sorted((*k, round(v, 6)) for k, v in best)
