"""Folds and percentiles that no group's rows meet in one buffer for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.operators import monitoring
from contentlens.operators.spacing import spaced
from contentlens.plans import registry

SF = "/root/testdata/sf0.001"


def test_spaced_times_of_hot_keys(spark):
    rng, rows, want = random.Random(3), [], set()
    for k, many, span in ((1, 5000, 40_000), (2, 300, 200_000), (None, 200, 3000), (3, 1, 10), (-4, 50, 700)):
        times = [rng.randrange(-span, span) for _ in range(many)]
        rows += [(k, t) for t in times]
        last = None
        for t in sorted(times):
            if last is None or t - last >= 100:
                want.add((k, t))
                last = t
    out = spaced(spark.createDataFrame([*rows, (1, None)], "k long, t long"), "k", "t", 100)
    got = [(r.k.k, r.t) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert spaced(spark.createDataFrame([], "k long, t long"), "k", "t", 100).count() == 0


def test_linear_percentiles(spark):
    df = spark.range(60_000).select(F.struct(F.when(F.col("id") % 3 > 0, F.col("id") % 3)).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v")).where("k.col1 = 1 or k.col1 is null or v < 1000")
    got = {r.k[0]: (r.a, r.b, r.c) for r in monitoring.linear_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.99}).collect()}
    assert set(got) == {None, 1, 2}
    for k, ps in got.items():
        vs = [r.v for r in df.where(F.col("k.col1").eqNullSafe(F.lit(k))).collect()]
        assert ps == pytest.approx(tuple(np.quantile(vs, [0.5, 0.95, 0.99])))


def test_latency_summary_keeps_no_values(spark):
    out = registry.QUERIES["latency_summary"](spark, SF)
    assert " percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    e = spark.read.parquet(f"{SF}/events.parquet")
    want = {r.event_type: r[1:] for r in e.groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6) for q in (0.5, 0.95, 0.99)]).collect()}
    assert {r.event_type: (r.p50, r.p95, r.p99) for r in out.collect()} == {k: pytest.approx(tuple(v)) for k, v in want.items()}
