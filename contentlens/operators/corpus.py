"""Corpus preparation: dedup, caps, balance, splits, leak removal, crops and mixes.

Where the order of a shuffle matters, md5 of an id gives it, so that a run can
be repeated.  Ranks over a whole table never pass through one task: rows are
counted by a hash bucket first and numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str = "") -> Column:
    """Hex digits that order rows as a seeded shuffle would."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def ranked(df: DataFrame, order: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the one-based rank of each row by a hex hash, within ``by``, and the group's size n.

    The first three digits are the bucket: at most 4096 counts a group are summed up and sent to all.
    """
    by = by or []
    rows = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    run = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__c").over(run), F.lit(0)).alias("__off"), F.sum("__c").over(W.partitionBy(*by)).alias("n"))
    within = F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h"))
    out = rows.withColumn("__r", within).join(offsets, [*by, "__b"])
    return out.withColumn(name, F.col("__r") + F.col("__off")).drop("__h", "__b", "__c", "__off", "__r")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key: each task gives one row a key before the shuffle, so that a key of very many rows is no large group."""
    first = F.min_by(F.struct(*df.columns), F.struct(order))  # a struct is never null, so null orders come first
    return df.groupBy(key.alias("__k")).agg(first.alias("__row")).select("__row.*")


def balance(df: DataFrame, label: str, order: Column) -> DataFrame:
    """As many rows of each label as the rarest has."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("__least"))
    return ranked(df, order, [label]).crossJoin(F.broadcast(least)).where("rank <= __least").drop("rank", "n", "__least")  # broadcast: one row


def split_by_rank(df: DataFrame, order: Column) -> DataFrame:
    """train, val, test at int(n * .8) and int(n * .9)."""
    r, n = F.col("rank"), F.col("n")
    name = F.when(r <= F.floor(n * 0.8), "train").when(r <= F.floor(n * 0.9), "val").otherwise("test")
    return ranked(df, order).withColumn("split", name).drop("rank", "n")


def split_stratified(df: DataFrame, label: str, order: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Each class by half-even rounded shares; what is left goes to train."""
    r, n = F.col("rank"), F.col("n")
    a, b, c = (F.bround(n * x) for x in ratios)
    name = F.when(r <= a, "train").when(r <= a + b, "val").when(r <= a + b + c, "test").otherwise("train")
    return ranked(df, order, [label]).withColumn("split", name).drop("rank", "n")


def drop_leaks(split: DataFrame, text: str = "text") -> DataFrame:
    """val and test lose texts of train; test also those of val."""
    rows = split.withColumn("__md5", F.md5(F.col(text).cast("binary")))
    part = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    val = part["val"].join(part["train"].select("__md5"), "__md5", "left_anti")
    test = part["test"].join(part["train"].select("__md5"), "__md5", "left_anti").join(part["val"].select("__md5"), "__md5", "left_anti")
    return part["train"].unionByName(val).unionByName(test).drop("__md5")


def cap_each(df: DataFrame, by: str, most: int | Column, order: Column) -> DataFrame:
    """At most ``most`` rows of each group: a per-source limit, which is the feature.  A null group is a group; no task orders a whole one."""
    limit = most if isinstance(most, Column) else F.lit(most)
    rows = df.select(F.struct(*df.columns).alias("__row"), F.struct(by).alias("__g"), order.alias("__o"), limit.alias("__most"))
    return ranked(rows, F.col("__o"), ["__g"]).where("rank <= __most").select("__row.*")


def oversample(df: DataFrame, hard: DataFrame, on: str, times: int) -> DataFrame:
    """Rows in ``hard`` stand ``times`` times, with weight 3 at least."""
    picked = df.join(hard.select(on).distinct(), on, "left_semi")
    rest = df.join(hard.select(on).distinct(), on, "left_anti")
    more = picked.withColumn("weight", F.greatest("weight", F.lit(3.0))).withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__i")
    return rest.unionByName(more.select(*rest.columns))


def crop(text: Column, key: Column, low: int = 512, high: int = 1024) -> Column:
    """A stretch of low to high characters that starts after a sentence end if one is near; null for short texts.

    Target length and start come from md5 of the key; the end snaps back to a full stop beyond .8 low.
    """
    n = F.length(text)
    draw = lambda seed: F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    target = (F.lit(low) + draw("len") % (high - low + 1)).cast("int")
    start = (draw("start") % F.greatest(n - target + 1, F.lit(1))).cast("int")
    at = F.locate(". ", F.substring(text, start + 1, F.lit(100)))
    start = F.when((start > 0) & (at > 0), start + at + 1).otherwise(start)
    piece = F.substring(text, start + 1, target)
    dot = F.length(piece) - F.locate(".", F.reverse(piece))
    cut = F.when((F.locate(".", piece) > 0) & (dot > low * 0.8), F.substring(piece, F.lit(1), dot + 1)).otherwise(piece)
    return F.when(n < low, None).when(n <= high, text).otherwise(cut)


def mixed(a: Column, b: Column) -> Column:
    """The first half of one text and the second half of another, each moved to a sentence end within 200 characters."""
    half = lambda t: F.floor(F.length(t) / 2).cast("int")

    def boundary(t: Column) -> Column:
        at = F.locate(". ", F.substring(t, half(t) + 1, F.lit(200)))
        return F.when(at > 0, half(t) + at + 1).otherwise(half(t))

    return F.concat(F.substring(a, F.lit(1), boundary(a)), F.lit(" "), F.substring(b, boundary(b) + 1, F.length(b)))
