"""Operators on small rows: invariants, edges, and plans."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contentlens.operators import corpus, evaluation, monitoring, series
from contentlens.operators.spacing import spaced
from contentlens.plans import registry

SF = "/root/testdata/sf0.001"


def test_entropy_of_three_labels(spark):
    df = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (0, 0, 0)], "a int, b int, c int")
    rows = df.where("a + b + c > 0").select(monitoring.entropy_bits([F.col("a"), F.col("b"), F.col("c")]).alias("h"))
    got = [r.h for r in rows.collect()]
    assert got == [pytest.approx(math.log2(3)), 0.0]


def test_psi_buckets_and_identity(spark):
    edges = [0, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0, 1.2)], "p double")
    counts = [r["count"] for r in monitoring.bucket_counts(df, [], "p", edges).orderBy("bucket").collect()]
    assert counts == [3, 1, 2, 2]
    h = lambda cs: spark.createDataFrame([(i, c) for i, c in enumerate(cs)], "bucket int, count long")
    prod = h([10, 20, 30, 40]).withColumn("k", F.lit(1))
    total = lambda ref: monitoring.psi(h(ref), prod, ["k"]).agg(F.sum("contribution")).first()[0]
    assert total([100, 200, 300, 400]) == pytest.approx(0) and total([400, 300, 200, 100]) > 0.25
    assert math.isfinite(total([0, 100, 0, 0]))


def test_nearest_rank_half_even(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 30, 40)], "k int, v int")
    r = monitoring.nearest_rank(df, ["k"], "v", {"p50": 0.5}).first()
    assert r.p50 == 30  # index 1.5 rounds to 2


def test_nearest_rank_of_many_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(9001)).alias("v"))
    got = {r.k: (r.a, r.b) for r in monitoring.nearest_rank(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k in (0, 1):
        vs = sorted(r.v for r in df.where(F.col("k") == k).collect())
        assert got[k] == (vs[round(0.5 * (len(vs) - 1))], vs[round(0.95 * (len(vs) - 1))])


def test_auroc_across_score_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.choice([None, float("nan"), -1e30, 1e30, 0.5, round(rng.random(), 3), rng.uniform(0.5, 0.5001)]), rng.randrange(2)) for _ in range(400)]
    order = lambda s: (s is not None, s is not None and s != s, s if s is not None and s == s else 0.0)
    for k in ("a", None):
        pos, neg = ([order(s) for g, s, y in rows if g == k and y == c] for c in (1, 0))
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        got = {r.k: r.auroc for r in evaluation.auroc(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s", "y").collect()}
        assert got[k] == pytest.approx(want)


def test_auroc_ties_and_single_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.1, 0), ("b", 0.3, 1)]
    got = {r.k: r.auroc for r in evaluation.auroc(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s", "y").collect()}
    assert got == {"a": 0.875, "b": None}


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (0, 5)], "k int, n int")
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    got = [(r.l, r.h) for r in df.where("n > 0").select(low.alias("l"), high.alias("h")).collect()]
    assert got[0][1] == pytest.approx(1.0) and got[1][0] == pytest.approx(0.0) and 0 < got[1][1] < 1


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    s = corpus.split_by_rank(df, corpus.hash_order(F.col("id")))
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    t = corpus.split_stratified(df, "label", corpus.hash_order(F.col("id")))
    assert {(r.label, r.split): r["count"] for r in t.groupBy("label", "split").count().collect()} == {(0, "train"): 600, (0, "val"): 75, (0, "test"): 75, (1, "train"): 200, (1, "val"): 25, (1, "test"): 25}
    b = corpus.balance(df, "label", corpus.hash_order(F.col("id")))
    assert {r["count"] for r in b.groupBy("label").count().collect()} == {250}


def test_rate_window_leaves_out_the_exact_minute(spark):
    rows = [(1, 0), (1, 59_999), (1, 60_000), (1, 60_000)]
    df = spark.createDataFrame(rows, "u int, ms long")
    got = sorted((r.ms, r.n) for r in df.withColumn("n", series.sliding_count(df, "u", "ms")).collect())
    assert got == [(0, 1), (59_999, 2), (60_000, 3), (60_000, 3)]


def test_open_run_ends_at_its_last_row(spark):
    rows = [(1, i, s) for i, s in enumerate([0.1, 0.8, 0.9, 0.2, 0.7, 0.8])]
    got = sorted((r.start, r.end) for r in series.flagged_runs(spark.createDataFrame(rows, "k int, t int, s double"), "k", "t", "s", 0.5).collect())
    assert got == [(1, 3), (4, 5)]


def test_folds_match_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random()) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    want = {}
    for k, _, v in rows:
        want[k] = 0.85 * want.get(k, 0.0) + 0.15 * v
    assert {r.k: r.ewma for r in series.ewma(df, "k", ["t"], "v").collect()} == {k: pytest.approx(v) for k, v in want.items()}
    times = [(1, t) for t in sorted(rng.sample(range(1000), 60))]
    kept = []
    for _, t in times:
        if not kept or t - kept[-1] >= 50:
            kept.append(t)
    assert sorted(r.t for r in spaced(spark.createDataFrame(times, "k int, t long"), "k", "t", 50).collect()) == kept


def test_cap_each_of_hot_and_null_groups(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 7 < 6 else "small", i) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, source string, n int").withColumn("rank", F.lit("mine"))
    got = [tuple(r) for r in corpus.cap_each(df, "source", 90, corpus.hash_order(F.col("id"))).select("source", "n", "rank").collect()]
    size = {s: sum(g[0] == s for g in got) for s in (None, "hot", "small")}
    assert size == {None: 90, "hot": 90, "small": 90} and {g[2] for g in got} == {"mine"}
    assert corpus.cap_each(df.where("id < 0"), "source", 90, corpus.hash_order(F.col("id"))).count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(10.0,), (30.0,), (30.5,), (86.0,), (86.5,)], "t double")
    assert [len(r.c) for r in df.select(series.chunks(F.col("t")).alias("c")).collect()] == [1, 1, 2, 3, 4]


def test_crop_and_mix(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "y" * 800), (3, "Word word. " * 400)], "id long, text string")
    got = {r.id: r.c for r in df.select("id", corpus.crop(F.col("text"), F.col("id")).alias("c")).collect()}
    assert got[1] is None and got[2] == "y" * 800 and 409 < len(got[3]) <= 1024 and got[3].endswith(".")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs_natively(spark, name):
    """Each query runs on the smallest tables and has SQL; none needs Python on the executors or has a Cartesian product."""
    df = registry.QUERIES[name](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name != "calibrated_scores":  # hulls of score ranges, in numpy
        assert not re.search("Python|Pandas|MapIn|Arrow", plan)
    assert "CartesianProduct" not in plan
    assert name in registry.ORACLES
