"""Calibration, sweeps of thresholds and resampled series, each against a plain computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.functions.alignment import alignment
from contentlens.operators import evaluation, isotonic


def pooled(rows):
    """Pool adjacent violators, one block after another."""
    blocks = []
    for s in sorted({s for s, _ in rows}):
        ys = [y for t, y in rows if t == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, s_ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + n, blocks[-1][2] + s_]
    return {s: p / n for p, n, ss in blocks for s in ss}


def rows_of(kind, seed):
    rng = random.Random(seed)
    if kind == "noisy":
        return [(round(rng.random(), 2), rng.randrange(2)) for _ in range(400)]
    if kind == "rising":
        return [(s := rng.random(), int(rng.random() < s * s)) for _ in range(300)]
    if kind == "falling":
        return [(i / 50, int(i < 25)) for i in range(50)]
    return [(0.5, 1), (0.5, 0), (0.5, 1)]


@pytest.mark.parametrize("kind, seed", [("noisy", 0), ("noisy", 1), ("rising", 2), ("falling", 0), ("one", 0)])
def test_isotonic(spark, kind, seed):
    rows = rows_of(kind, seed)
    df = spark.createDataFrame(rows, "s double, y int").repartition(5)
    got = {r.s: r.isotonic for r in isotonic.isotonic(isotonic.counts(df, "s", "y")).collect()}
    assert got == pytest.approx(pooled(rows))


def test_platt_is_the_optimum(spark):
    rows = [*rows_of("rising", 3), (0.0, 0), (1.0, 1)]
    a, b = isotonic.platt(isotonic.counts(spark.createDataFrame(rows, "s double, y int"), "s", "y"))
    s, y = np.clip([r[0] for r in rows], 1e-6, 1 - 1e-6), np.array([r[1] for r in rows])
    x = np.log(s / (1 - s))
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((p - y) * x).sum() + a / 1e4) < 1e-8 and abs((p - y).sum()) < 1e-8 and a > 0


def test_calibrated_odd_rows(spark):
    rows = [(0.2, 0), (0.4, 1), (0.4, 0), (0.9, 1), (None, 1), (float("nan"), 0), (0.7, None), (0.4, 1)]
    got = isotonic.calibrated(spark.createDataFrame(rows, "s double, y int").withColumn("n", F.lit("x")), "s", "y").collect()
    assert len(got) == len(rows)
    by = {r.s: r for r in got}
    assert by[0.4].isotonic == pytest.approx(2 / 3) and by[0.2].calibrated >= 0.01 and by[0.9].calibrated <= 0.99
    assert all(by[s].calibrated is None for s in by if s is None or s != s or s == 0.7)  # .7 has no label, so no block
    assert isotonic.calibrated(spark.createDataFrame([], "s double, y int"), "s", "y").count() == 0


@pytest.mark.parametrize("seed, max_fn, max_fp", [(0, 0.02, 0.15), (1, 0.1, 0.5), (2, -1.0, 0.15)])
def test_tier_grid(spark, seed, max_fn, max_fp):
    rng = random.Random(seed)
    rows = [(round(min(1.0, max(0.0, rng.gauss(0.3 + 0.4 * y, 0.2))), 2), y) for y in (rng.randrange(2) for _ in range(300))]
    got = evaluation.tier_grid(spark.createDataFrame([*rows, (None, 1), (0.3, None)], "s double, y int"), "s", "y", max_fn, max_fp).collect()
    ai, human, best = [s for s, y in rows if y], [s for s, y in rows if not y], (0.0, None)
    for i in range(1, 9):
        for j in range(i + 1, 16):
            fn, skip, flagged = sum(s < i / 20 for s in ai) / len(ai), sum(s < j / 20 for s, _ in rows) / len(rows), sum(s >= j / 20 for s in human) / len(human)
            r = next(r for r in got if (r.skip_t, r.flag_t) == (i / 20, j / 20))
            assert (r.fn_rate, r.skip_rate, r.flagged) == pytest.approx((fn, skip, flagged)) and r.allowed == (fn <= max_fn and flagged <= 1 - max_fp)
            if r.allowed and skip > best[0]:
                best = (skip, (i / 20, j / 20))
    assert len(got) == 84 and [(r.skip_t, r.flag_t) for r in got if r.best] == ([best[1]] if best[1] else [])


def test_alignment(spark):
    rng = random.Random(1)
    series = lambda n: [rng.random() for _ in range(n)]
    pairs = [(series(a), series(b)) for a, b in [(0, 5), (1, 5), (2, 9), (3, 3), (3, 50), (19, 20), (20, 21), (77, 40)]]
    pairs += [([0.9] * 5, series(6)), ([0.1, 0.2, 0.3], [0.9, 0.8, 0.7]), ([0.5] * 3, [0.5] * 4), (None, series(4))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, v array<double>, a array<double>")
    got = {r.id: r for r in df.select("id", *[c.alias(n) for n, c in alignment(F.col("v"), F.col("a")).items()]).collect()}
    for i, (v, a) in enumerate(pairs):
        r = got[i]
        if v is None or min(len(v), len(a)) < 3:
            assert (r.points, r.consistency, r.mismatch, r.severity, r.correlation) == (0, 0.5, False, "none", None)
            continue
        n = min(len(v), len(a), 20)
        x, y = (np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(s)), s) for s in (v, a))
        flat = len(set(v)) == 1 or len(set(a)) == 1
        corr, gap = 0.0 if flat else np.corrcoef(x, y)[0, 1], abs(x.mean() - y.mean())
        assert (r.points, r.correlation, r.gap, r.consistency) == pytest.approx((n, corr, gap, (corr + 1) / 2 * (1 - min(gap, 1))))
        assert r.mismatch == (gap > 0.3 and corr < 0.3)
        assert r.severity == ("high" if gap > 0.5 else "medium" if gap > 0.3 else "low" if gap > 0.15 else "none")
