"""Times kept with a least distance, without a fold: pointers to the next time, doubled.

What is kept after time t is the first candidate at or after t + gap, so the
candidates form a forest of pointers and the answer is the path from a key's
first one.  The pointer of t is found in cells of ``gap`` milliseconds: in the
next cell if something there is late enough, else at the start of the next cell in use.  Then

    kept := kept + jump(kept),   jump := jump of jump,

as joins on (key, time), as often as the logarithm of the longest path.  A key's
rows are spread over tasks by cell and by time; a window by key sees one row a cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.operators.shared import written


def _next(times: DataFrame, gap: int) -> DataFrame:
    """k, t and n, the first time at or after t + gap; rows without one are left out."""
    cell = F.floor(F.col("t") / gap)
    cells = times.groupBy("k", cell.alias("c")).agg(F.min("t").alias("lo"))
    w = W.partitionBy("k").orderBy("c")
    after = cells.select("k", "c", *[F.lead(x, i).over(w).alias(f"{x}{i}") for x, i in (("c", 1), ("lo", 1), ("lo", 2))])
    there = times.select("k", "t", F.col("t").alias("at"), cell.alias("c"), F.lit(False).alias("asks"))
    asks = times.select("k", "t", (F.col("t") + gap).alias("at"), (cell + 1).alias("c"), F.lit(True).alias("asks"))
    down = W.partitionBy("k", "c").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, 0)
    found = there.unionByName(asks).withColumn("n", F.min(F.when(~F.col("asks"), F.col("t"))).over(down)).where("asks")
    found = found.select("k", "t", "n", (F.col("c") - 1).alias("c")).join(after, ["k", "c"])
    later = F.when(F.col("c1") > F.col("c") + 1, F.col("lo1")).otherwise(F.col("lo2"))
    return found.select("k", "t", F.coalesce("n", later).alias("n")).where("n is not null")


def spaced(df: DataFrame, key: str | Column, time: str | Column, gap: int) -> DataFrame:
    """k (a struct of the key, so that null is a key too) and t (long): the times kept of each key, the first one and each first one ``gap`` or more after.

    Null times are left out, equal times count once.
    """
    times = df.select(F.struct(key).alias("k"), F.col(time).cast("long").alias("t") if isinstance(time, str) else time.cast("long").alias("t"))
    times = written(times.where("t is not null").distinct())
    kept, jump = times.groupBy("k").agg(F.min("t").alias("t")), written(_next(times, gap))
    while not jump.isEmpty():
        kept = written(kept.unionByName(kept.join(jump, ["k", "t"]).select("k", F.col("n").alias("t"))).distinct())
        jump = written(jump.join(jump.select("k", F.col("t").alias("n"), F.col("n").alias("m")), ["k", "n"]).select("k", "t", F.col("m").alias("n")))
    return kept
