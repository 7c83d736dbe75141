"""Ordered analytics: sliding counts, sessions, runs, rolling scores, drift of vectors, overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def sliding_count(df: DataFrame, key: str, ms: str, span: int = 60_000) -> Column:
    """Rows of the key in the last ``span`` milliseconds, this one included, one exactly ``span`` old left out; ties all count."""
    return F.count(F.lit(1)).over(W.partitionBy(key).orderBy(ms).rangeBetween(-(span - 1), 0))


def sessions(df: DataFrame, key: str, ms: str, order: list[str], gap: int) -> DataFrame:
    """Adds the session number of each row: a gap over ``gap`` milliseconds starts a new one."""
    w = W.partitionBy(key).orderBy(ms, *order)
    new = F.when(F.col(ms) - F.lag(ms).over(w) < gap, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def flagged_runs(df: DataFrame, key: str, at: str, score: str, threshold: float) -> DataFrame:
    """Runs of rows at or over the threshold: start, end (the first row past the run, or its own last), mean and peak."""
    w = W.partitionBy(key).orderBy(at)
    flag = F.col(score) >= threshold
    rows = df.withColumn("__on", flag).withColumn("__next", F.lead(at).over(w))
    rows = rows.withColumn("__change", F.when(F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("__change").over(w.rowsBetween(W.unboundedPreceding, 0))).where("__on")
    return rows.groupBy(key, "run").agg(F.min(at).alias("start"), F.coalesce(F.max_by("__next", at), F.max(at)).alias("end"), F.avg(score).alias("mean"), F.max(score).alias("peak"))


def rolling_mean(key: str, order: list[str], value: str, rows: int = 4) -> Column:
    return F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0))


def ewma(df: DataFrame, key: str, order: list[str], value: str, decay: float = 0.85) -> DataFrame:
    """c = decay c + (1 - decay) m from 0, at each key's end: the fold in closed form, so partial sums can be combined."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    rows = df.withColumn("__back", F.row_number().over(w) - 1)
    return rows.groupBy(key).agg(F.sum((1 - decay) * F.pow(F.lit(decay), F.col("__back")) * F.col(value)).alias("ewma"))


def differences(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First and second differences."""
    w = W.partitionBy(key).orderBy(*order)
    first = df.withColumn("d1", F.col(value) - F.lag(value).over(w))
    return first.withColumn("d2", F.col("d1") - F.lag("d1").over(w))


def correlated(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    """keys, pairs (the rows of a key) and the correlation of x and y over rows with both: NaN where one of them is constant, null without such rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    of = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.covar_pop(x, y).alias("__cov"), (of(x) * of(y)).alias("__spread"))
    return g.select(*keys, "pairs", F.when(F.col("__spread") == 0, float("nan")).otherwise(F.try_divide("__cov", "__spread")).alias(name))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def chunks(total: Column, size: float = 30.0, overlap: float = 2.0) -> Column:
    """Overlapping chunks (start, end) of a duration: they stop with the first that reaches its end."""
    hop = size - overlap
    n = F.greatest(F.ceil((total - size) / hop), F.lit(0))
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct((i * hop).alias("start"), F.least(i * hop + size, total).alias("end")))
