"""Calibration of scores over whole tables: isotonic and logistic fits from counts by score.

The isotonic fit is the slope of the lower convex hull of the points (rows so
far, positives so far) in order of score.  The hull of a table is the hull of
the hulls of its parts, so each range of scores gives its own, in numpy, and one task joins
them: as the points are whole numbers, n rows have no more than some n**(2/3) vertices.
The logistic fit (Platt) is Newton's method on two numbers, each step a few sums over the counts.

Scores are expected from 0 to 1; null or NaN scores and null labels take no part in the fits and get nulls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.operators.shared import written

#: Ranges of scores that are handled together; the logistic fit's weight of data against its penalty; its steps.
PARTS, C, STEPS = 1024, 1e4, 30


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the vertices of the lower convex hull of points in order of x; exact for whole numbers."""
    kept: list[int] = []
    xs, ys = x.tolist(), y.tolist()
    for i, (a, b) in enumerate(zip(xs, ys)):
        while len(kept) > 1:
            j, k = kept[-2], kept[-1]
            if (xs[k] - xs[j]) * (b - ys[j]) - (ys[k] - ys[j]) * (a - xs[j]) > 0:
                break
            kept.pop()
        kept.append(i)
    return np.array(kept, np.int64)


def _hull_of(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("cx", ignore_index=True)
    return group.iloc[hull(group["cx"].to_numpy(), group["cy"].to_numpy())][["cx", "cy"]]


def _slopes(group: pd.DataFrame) -> pd.DataFrame:
    group = pd.concat([pd.DataFrame({"cx": [0], "cy": [0]}), group]).sort_values("cx", ignore_index=True)
    kept = group.iloc[hull(group["cx"].to_numpy(), group["cy"].to_numpy())]
    x, y = kept["cx"].to_numpy(), kept["cy"].to_numpy()
    return pd.DataFrame({"cx": x[1:], "slope": np.diff(y) / np.diff(x)})


def counts(df: DataFrame, score: str, y: str) -> DataFrame:
    """s, n, pos for each distinct score, written to the shared folder."""
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull()
    return written(df.where(ok).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")))


def isotonic(by_score: DataFrame) -> DataFrame:
    """s and isotonic, the non-decreasing fit, for each score of counts()."""
    rows = by_score.withColumn("part", F.least(F.greatest(F.floor(F.col("s") * PARTS), F.lit(0)), F.lit(PARTS)))
    sums = rows.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most PARTS + 1 rows
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("pn", "pp")])
    here = W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"hn": F.sum("n").over(here), "hp": F.sum("pos").over(here)}).join(sums, "part")
    points = written(rows.select("part", "s", (F.col("hn") + F.col("pn")).alias("cx"), (F.col("hp") + F.col("pp")).alias("cy")))
    parts = points.groupBy("part").applyInPandas(_hull_of, "cx long, cy long")
    vertices = written(parts.groupBy().applyInPandas(_slopes, "cx long, slope double"))
    marked = points.join(vertices, "cx", "left")
    # a score takes the slope of the first vertex at or after it: in its range, or in a later one
    down = W.partitionBy("part").orderBy(F.desc("cx")).rowsBetween(W.unboundedPreceding, 0)
    firsts = marked.groupBy("part").agg(F.min_by("slope", F.when(F.col("slope").isNotNull(), F.col("cx"))).alias("first"))
    later = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("part", F.last("first", ignorenulls=True).over(later).alias("later"))
    own = marked.withColumn("own", F.last("slope", ignorenulls=True).over(down))
    return own.join(firsts, "part").select("s", F.coalesce("own", "later").alias("isotonic"))


def log_odds(s: Column) -> Column:
    c = F.least(F.greatest(s, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(c / (1 - c))


def platt(by_score: DataFrame, steps: int = STEPS) -> tuple[float, float]:
    """Slope and intercept of the logistic fit on the log odds, with a penalty of slope**2 / (2 C)."""
    x, n, pos = log_odds(F.col("s")), F.col("n"), F.col("pos")
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(a * x + b)))
        r, w = n * p - pos, n * p * (1 - p)
        ga, gb, haa, hab, hbb = by_score.agg(F.sum(r * x), F.sum(r), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        if ga is None:
            return 0.0, 0.0
        ga, haa = ga + a / C, haa + 1 / C
        det = haa * hbb - hab * hab
        if not det:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if not math.isfinite(a + b):
            raise ArithmeticError("the classes are apart: the logistic fit has no end")
        if abs(da) + abs(db) < 1e-13 * (1 + abs(a) + abs(b)):
            break
    return a, b


def calibrated(df: DataFrame, score: str, y: str) -> DataFrame:
    """Adds platt, isotonic and calibrated, their mean clipped to .01 and .99."""
    by_score = counts(df, score, y)
    a, b = platt(by_score)
    out = df.join(isotonic(by_score).withColumnRenamed("s", "__s"), F.col(score).cast("double") == F.col("__s"), "left").drop("__s")
    fit = F.when(F.isnan(F.col(score).cast("double")), None).otherwise(1 / (1 + F.exp(-(a * log_odds(F.col(score).cast("double")) + b))))
    mean = (F.col("platt") + F.col("isotonic")) / 2
    return out.withColumn("platt", fit).withColumn("calibrated", F.when(mean.isNotNull(), F.least(F.greatest(mean, F.lit(0.01)), F.lit(0.99))))
