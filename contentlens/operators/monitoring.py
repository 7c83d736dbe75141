"""Monitoring aggregates over prediction logs: day metrics, drift, calibration, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values
LENGTH_EDGES = (0, 100, 500, 2000, 10000)
LABELS = ("AI", "HUMAN", "UNCERTAIN")
EPSILON = 1e-6


def entropy_bits(counts: list[Column]) -> Column:
    """Shannon entropy of a few counts; empty parts add nothing, no rows give 0."""
    total = sum(counts[1:], counts[0])
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return sum(parts[1:], parts[0])


def day_metrics(predictions: DataFrame) -> DataFrame:
    """One row a day.  The standard deviation is that of a population and null for a single row."""
    n = F.count(F.lit(1))
    label = {k: F.count_if(F.col("final_label") == k) for k in LABELS}
    one = predictions.groupBy("day").agg(
        n.alias("n_predictions"),
        F.avg("p").alias("mean_probability"),
        F.when(n > 1, F.stddev_pop("p")).alias("probability_stddev"),
        *[c.alias(f"n_{k.lower()}") for k, c in label.items()],
        F.avg("l1_score").alias("l1_mean"), F.avg("l2_score").alias("l2_mean"), F.avg("l3_score").alias("l3_mean"),
        F.avg(F.col("l3_score").isNull().cast("double")).alias("fallback_rate"),
        F.percentile("input_length", 0.5).alias("length_median"), F.max("input_length").alias("length_max"),
    )
    counts = [F.col(f"n_{k.lower()}") for k in LABELS]
    return one.withColumn("entropy_bits", entropy_bits(counts)).withColumn("ai_fraction", F.col("n_ai") / F.col("n_predictions"))


def _by_group(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds what there is a group; without keys the whole table is one, and its one row is broadcast."""
    return df.join(groups, keys) if keys else df.crossJoin(F.broadcast(groups))


def nearest_rank(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], method: str = "round") -> DataFrame:
    """Order statistics at index round_half_even(q (n - 1)), floor(n q) capped, or the lower or upper neighbour of q (n - 1), of a group: exact, without interpolation.

    A sketch brackets each rank first; only distinct values within a bracket,
    a five-hundredth of the rows or so, are ordered, and the rest is counted.
    """
    slack, accuracy = 0.001, 10_000
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    ends = F.array(*[F.lit(max(0.0, q - slack) if low else min(1.0, q + slack)) for q in qs.values() for low in (True, False)])
    # one sketch a group for all ends
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", ends, F.lit(accuracy)).alias("__e"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    small = F.col("n") < 10 / slack  # too few rows for the slack to cover a rank on either side
    out = bounds.select(*keys)
    for i, (name, q) in enumerate(qs.items()):
        place = F.lit(q) * (F.col("n") - 1)
        at = {"round": F.bround(place), "floor": F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1), "lower": F.floor(place), "upper": F.ceil(place)}[method]
        one = bounds.select(*keys, at.alias("__at"), F.when(small, F.col("__min")).otherwise(F.col("__e")[2 * i]).alias("__lo"), F.when(small, F.col("__max")).otherwise(F.col("__e")[2 * i + 1]).alias("__hi"))
        near = _by_group(rows, one, keys).where("__v <= __hi")
        # what lies below the bracket counts as one value of it
        counts = near.groupBy(*keys, "__at", F.greatest("__v", "__lo").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
        hit = counts.withColumn("__upto", upto).where(F.col("__upto") > F.col("__at")).groupBy(*keys).agg(F.min("__v").alias(name))
        out = _by_group(out, hit, keys)
    return out


def linear_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between the two ranks around q (n - 1): exact, and no group's values meet in one buffer."""
    rows = df.where(F.col(value).isNotNull())
    low, high = (nearest_rank(rows, keys, value, {f"__{m}_{name}": q for name, q in qs.items()}, m) for m in ("lower", "upper"))
    both = _by_group(_by_group(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), low, keys), high, keys)
    part = lambda q: F.lit(q) * (F.col("__n") - 1) - F.floor(F.lit(q) * (F.col("__n") - 1))
    mixed = lambda name, q: (1 - part(q)) * F.col(f"__lower_{name}") + part(q) * F.col(f"__upper_{name}")
    return both.select(*keys, *[mixed(name, q).alias(name) for name, q in qs.items()])


def length_bucket(length: Column) -> Column:
    names = [f"{a}-{b}" for a, b in zip(LENGTH_EDGES, LENGTH_EDGES[1:])] + [f"{LENGTH_EDGES[-1]}+"]
    out = None
    for lo, name in zip(LENGTH_EDGES, names):
        out = F.when(length >= lo, name) if out is None else F.when(length >= lo, name).otherwise(out)
    return out


def psi_bucket(p: Column, edges: list[float]) -> Column:
    """The first bucket is closed on both sides, the others open on the left; null outside."""
    out = F.when((p >= edges[0]) & (p <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((p > edges[i]) & (p <= edges[i + 1]), i)
    return out


def bucket_counts(df: DataFrame, keys: list[str], p: str, edges: list[float]) -> DataFrame:
    """keys, bucket, count for every bucket, zeros included."""
    counted = df.withColumn("bucket", psi_bucket(F.col(p), edges)).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("count"))
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = grid.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return grid.join(counted, [*keys, "bucket"], "left").fillna(0, ["count"])


def psi(reference: DataFrame, production: DataFrame, keys: list[str]) -> DataFrame:
    """Population stability of each production histogram against one reference; a contribution a bucket."""
    ref = reference.select("bucket", F.col("count").alias("ref_count"), F.greatest(F.sum("count").over(W.partitionBy()), F.lit(1)).alias("n_ref"))
    total = F.greatest(F.sum("count").over(W.partitionBy(*keys)), F.lit(1))
    both = production.withColumn("n_prod", total).join(F.broadcast(ref), "bucket")  # broadcast: one row a bucket
    q, p = F.greatest(F.col("ref_count") / F.col("n_ref"), F.lit(EPSILON)), F.greatest(F.col("count") / F.col("n_prod"), F.lit(EPSILON))
    return both.select(*keys, "bucket", "ref_count", F.col("count").alias("prod_count"), ((p - q) * F.ln(p / q)).alias("contribution"))


def calibration_bins(df: DataFrame, p: str, y: Column, n_bins: int = 10, closed: str = "left", drop_edge: bool = False) -> DataFrame:
    """bin, count, mean predicted and share of positives; y null counts towards the first two only.

    ``closed`` left: [lo, hi), the last bin closed unless drop_edge; right: (lo, hi], which drops 0.
    Bins without rows or without labels take the midpoint and 0, or 0.5.
    """
    x = F.col(p) * n_bins
    at = (F.ceil(x) - 1 if closed == "right" else (F.floor(x) if drop_edge else F.least(F.floor(x), F.lit(n_bins - 1)))).cast("int")
    rows = df.select(F.col(p).alias("p"), y.cast("double").alias("y"), at.alias("bin")).where(F.col("bin").between(0, n_bins - 1))
    got = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_pred"), F.avg("y").alias("frac_pos"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    mid = (F.col("bin") + 0.5) / n_bins
    frac = F.when(F.col("count").isNull(), 0.0).otherwise(F.coalesce("frac_pos", F.lit(0.5)))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("mean_pred", mid).alias("mean_pred"), frac.alias("frac_pos"))


def ece_mce(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_pred") - F.col("frac_pos"))
    full = bins.where("count > 0")
    return full.agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"), F.max(gap).alias("mce"), F.sum("count").alias("n"))


def cumulative_buckets(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Counts at or below each edge, and in all (edge +Inf is null)."""
    counts = df.groupBy(*keys).agg(F.array(*[F.count_if(F.col(value) <= e) for e in edges], F.count(F.lit(1))).alias("c"))
    zipped = F.arrays_zip(F.array(*[F.lit(float(e)) for e in edges], F.lit(None).cast("double")).alias("le"), F.col("c").alias("n"))
    return counts.select(*keys, F.inline(zipped))


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation within its bucket; the open bucket gives its lower edge."""
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last("le"))
    rows = buckets.select(
        *keys, "le", "n", F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lo"), F.max("n").over(W.partitionBy(*keys)).alias("total")
    )
    rank = F.col("total") * q
    hit = rows.where((F.col("n") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0) & (rank == 0)))
    value = F.when(F.col("le").isNull(), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(rank - F.col("below"), F.col("n") - F.col("below")))
    return hit.groupBy(*keys).agg(F.min(value).alias("quantile"))
