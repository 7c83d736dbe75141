"""Evaluation of scores against labels: confusion, ranking, intervals, sweeps and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: list[str], says: Column, y: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy, 0 where a part is empty."""
    yes, true = says, F.col(y) == 1
    g = df.groupBy(*keys).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return g.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1))})


#: Parts of a unit of score that are ranked together.
PARTS = 4096


def auroc(df: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged.  Null for one class.

    Counts by distinct score come first, and those are ranked within narrow ranges
    of the score, each above the sum of those below: no task orders all scores of a key.
    """
    part = F.when(F.isnan(score), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col(score).cast("double") * PARTS))
    g = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("__part", part)
    sums = g.groupBy(*keys, "__part").agg(F.sum("n").alias("n"))
    under = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by = [*keys, "__part"]
    offsets = sums.select(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(by)], under.alias("__under"))
    here = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = g.withColumn("__here", here).join(offsets, [F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate(by)])
    ranked = placed.withColumn("rank", F.col("__under") + F.col("__here") + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return s.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auroc"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, clamped; (0, 0) without rows."""
    p = F.try_divide(k, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def sweep(df: DataFrame, score: str, y: str, thresholds: list[float], at_least: bool = False) -> DataFrame:
    """Confusion at each threshold (score > t, or >= t), from counts by distinct score: rows are read once."""
    g = df.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    rows = g.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    over = F.col(score) >= F.col("threshold") if at_least else F.col(score) > F.col("threshold")
    zero = F.lit(0)
    s = rows.groupBy("threshold").agg(
        F.sum(F.when(over, F.col("pos")).otherwise(zero)).alias("tp"), F.sum(F.when(over, F.col("n") - F.col("pos")).otherwise(zero)).alias("fp"), F.sum(F.when(~over, F.col("pos")).otherwise(zero)).alias("fn")
    )
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero.cast("double")))


def simplex(spark: SparkSession, step: int = 20) -> DataFrame:
    """Weights (w1, w2, w3) in steps of 1 / step that sum to 1."""
    i = spark.range(step + 1).select(F.col("id").alias("i"))
    grid = i.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(step) - F.col("i"))))
    return grid.select((F.col("i") / step).alias("w1"), (F.col("j") / step).alias("w2"), ((F.lit(step) - F.col("i") - F.col("j")) / step).alias("w3"))


def exceeded(s: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds s exceeds, by bisection; 0 for null."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(s > thresholds[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(thresholds))


def grid_search(df: DataFrame, scores: list[str], y: str, thresholds: list[float], step: int = 20) -> DataFrame:
    """Confusion of every weight vector and threshold.

    Rows are first counted by their scores as they are; each vector's fused
    score falls in one of len(thresholds) + 1 cells, so that a vector is a
    small histogram before anything is shuffled.
    """
    spark, ts = df.sparkSession, sorted(thresholds)
    small = df.groupBy(*scores).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    fused = small.crossJoin(F.broadcast(simplex(spark, step)))  # broadcast: (step + 1)(step + 2) / 2 rows
    s = sum((F.col(c) * F.col(f"w{i + 1}") for i, c in enumerate(scores)), F.lit(0.0))
    cells = fused.withColumn("s", s).groupBy("w1", "w2", "w3", exceeded(F.col("s"), ts).alias("cell")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)]))
    wide, over = cells.withColumn("z", at), lambda c: F.sum(F.when(F.col("cell") > F.col("z.i"), F.col(c)).otherwise(0))
    out = wide.groupBy("w1", "w2", "w3", F.col("z.threshold").alias("threshold")).agg(over("pos").alias("tp"), over("n").alias("yes"), F.sum("pos").alias("p"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("yes") + F.col("p")), F.lit(0.0)))


def weighted_mean(parts: list[tuple[Column, Column, float]]) -> Column:
    """Mean of scores by weight over the parts that hold; .5 if none does.  A part: score, holds, weight."""
    zero = F.lit(0.0)
    total = sum((F.when(ok, F.lit(w)).otherwise(zero) for _, ok, w in parts), zero)
    return F.coalesce(F.try_divide(sum((F.when(ok, s * w).otherwise(zero) for s, ok, w in parts), zero), total), F.lit(0.5))


def tier_grid(df: DataFrame, fast: str, y: str, max_fn: float = 0.02, max_fp: float = 0.15) -> DataFrame:
    """Pairs of thresholds for two tiers: below skip_t the fast score decides, below flag_t the deep pass is spared.

    For each pair (skip_t from .05 to .40, flag_t above it to .75, steps of .05): fn_rate, the share of positives below skip_t; skip_rate, the share of
    rows below flag_t; flagged, the share of negatives at or over it; allowed, if fn_rate <= max_fn and flagged <= 1 - max_fp; best, on the pair of the
    largest positive skip_rate that is allowed, ties to the smaller skip_t, then flag_t.  Rows are read once and counted in cells of .05; null scores or labels take no part.
    """
    steps = F.array(*[F.lit(i / 20) for i in range(1, 16)])
    cell = F.size(F.filter(steps, lambda t: F.col(fast) >= t))  # thresholds at or under the score
    cells = df.where(F.col(fast).isNotNull() & F.col(y).isNotNull()).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))  # 16 rows at most
    whole = cells.agg(F.collect_list(F.struct("cell", "n", "pos")).alias("cells"))

    def under(i: Column, of) -> Column:
        return F.aggregate(F.filter("cells", lambda c: c["cell"] < i), F.lit(0).cast("long"), lambda s, c: s + of(c))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.transform(F.sequence(i + 1, F.lit(15)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    top = F.lit(99)
    pos, neg = (lambda c: c["pos"]), (lambda c: c["n"] - c["pos"])
    g = whole.select("cells", F.explode(pairs).alias("p")).select(
        (F.col("p.i") / 20).alias("skip_t"), (F.col("p.j") / 20).alias("flag_t"),
        (under(F.col("p.i"), pos) / F.greatest(under(top, pos), F.lit(1))).alias("fn_rate"), F.try_divide(under(F.col("p.j"), lambda c: c["n"]), under(top, lambda c: c["n"])).alias("skip_rate"),
        F.try_divide(under(top, neg) - under(F.col("p.j"), neg), under(top, neg)).alias("flagged"),
    )
    g = g.withColumn("allowed", (F.col("fn_rate") <= max_fn) & F.coalesce(F.col("flagged") <= 1 - max_fp, F.lit(True)))
    first = F.row_number().over(W.orderBy(F.desc("allowed"), F.desc("skip_rate"), "skip_t", "flag_t"))  # 92 rows
    return g.withColumn("best", F.coalesce((first == 1) & F.col("allowed") & (F.col("skip_rate") > 0), F.lit(False)))
