"""Mixing sources to target weights, by blocks.

The words of each source, its documents in a seeded order, form one stream that
is packed into blocks of ``block`` words.  A source fills as many slots of the
mix as round(target) words take, the short last block counted as it is; the
last slot is cut to the words still missing.  How many of them each output shard holds is a
multinomial draw; conditioned on their number, so that no source drifts from its target.
Slot k of a source maps to block perm(k mod blocks), with a pseudorandom
permutation of its own for each source and epoch, and blocks join the slots by
number.  As a target is at most most * size, no word is taken more than ``most`` times.

Sizes are words.  Sources by code point, null last, weigh ``weights`` in turn
and share all words; a target stops at ``most`` times its source's size, and
the excess is shared again by weight until none is above.

However many sources there are, they stay a table: they are numbered by ranges,
the common level of the targets is found by sums over them, and each draws its
slots in a task.  The driver sees a few sums.

Defined cases: a null or empty text has size 0 and is never taken; an empty
table gives an empty mix; repeated rows are documents of their own; rows with a
null id take part like any other; extra columns pass through ``mixed_documents``
(of any type, and whatever their names; rows that differ only in columns of
types without a hash may change places between runs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.llm.common import WORD, free, hashable, materialise, shuffle_partitions, words

WEIGHTS, MOST, BLOCK, SHARDS = (5.0, 2.0, 1.0), 3, 128, 64
#: Rows of a source that one window puts in order, about: the number of hash ranges follows the table.
WINDOW = 1 << 20
#: Slot numbers that one row of the plan unfolds to.
CHUNK = 8192


def sizes(documents: DataFrame, row: str) -> DataFrame:
    """Documents without text: row, doc_id, source, size in words, and two hashes of the row that put it in order."""
    columns = [F.col(f"`{c}`") for c in hashable(documents) if c != row]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col(row).alias("row"), "doc_id", "source", size.alias("size"), *[F.xxhash64(*columns, F.lit(k)).alias(f"h{k}") for k in (1, 2)])


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_no, source_size and target of each source."""
    order = F.asc_nulls_last("source")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = totals.repartitionByRange(shuffle_partitions(sized.sparkSession), order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    no = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    numbered = dealt.withColumn("no", no).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    number = (F.col("no") + F.col("before")).cast("int")
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(number, F.lit(len(weights))))
    rows = materialise(numbered.select("source", number.alias("source_no"), "source_size", weight.alias("weight")))
    level = water_level(rows, most)
    target = F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight"))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def water_level(rows: DataFrame, most: float) -> float:
    """The level at which the least of level * weight and most * source_size, summed over the sources, gives all words."""
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = float(total or 0) / weight if weight else 0.0, 0
    while True:
        cap = most * F.col("source_size").cast("double")
        over = cap < F.lit(level) * F.col("weight")
        n, fixed, left = rows.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not left:
            return level
        level, full = (total - fixed) / left, n


def pack(sized: DataFrame, seed: int) -> DataFrame:
    """Adds start: a document holds [start, start + size) of its source's stream; null for size 0.

    The stream follows a seeded hash: first its highest bits, then its rank
    among those that share them, so that no window holds much of a source.
    """
    bits = max(10, (sized.count() // WINDOW).bit_length())
    h = F.xxhash64("h1", F.lit(seed))
    rows = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("source_no", "bucket", offset.alias("offset"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("source_no", "bucket").orderBy("h", "h2", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    packed = rows.withColumn("inner", inner).join(offsets, ["source_no", "bucket"])
    start = F.when(F.col("size") > 0, F.col("inner") + F.col("offset"))
    return packed.select("row", "doc_id", "source_no", "source_size", "target", "size", start.alias("start"))


def permute(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at places i: a Feistel network on the next even power of two, walked until it falls below n."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << bits) - 1), i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(bits), x & mask
        for r in range(4):
            mixed = (right + np.uint64((seed * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(bits)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def unpermute(i: int, n: int, seed: int) -> int:
    """The place at which permute(., n, seed) gives i: its rounds backwards."""
    bits, full = max(1, (max(n - 1, 1).bit_length() + 1) // 2), 2**64 - 1
    mask = (1 << bits) - 1
    while True:
        left, right = i >> bits, i & mask
        for r in reversed(range(4)):
            mixed = (left + (seed * 4 + r + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & full
            mixed = (mixed ^ (mixed >> 29)) * 0x94D049BB133111EB & full
            left, right = right ^ ((mixed >> 32) & mask), left
        i = (left << bits) | right
        if i < n:
            return i


def _seed(seed: int, no: int, epoch: int) -> int:
    return seed * 1_000_003 + no * 101 + epoch


def slots_for(words: int, size: int, block: int, seed: int, no: int) -> tuple[int, int]:
    """Slots that take ``words`` words of a source, and the words of the last one."""
    if not size or not words:
        return 0, 0
    n, (epochs, left) = -(-size // block), divmod(words, size)
    if not left:
        return epochs * n, block
    short = n * block - size
    k, end = -(-left // block), unpermute(n - 1, n, _seed(seed, no, epochs))
    if end < k and left + short > k * block:  # the short block comes before the words are full
        k += 1
    have = (k - 1) * block - (short if end < k - 1 else 0)
    return epochs * n + k, left - have


def plan(sources: DataFrame, seed: int, block: int, shards: int) -> DataFrame:
    """Slots of the mix: shard, source_no, slot (number k in its source), epoch, block_no, upto (words of the block that it takes at most)."""
    parts = shuffle_partitions(sources.sparkSession)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            draws = []
            for no, size, aim in b[["source_no", "source_size", "target"]].itertuples(index=False):
                k, cut = slots_for(round(aim), int(size), block, seed, int(no))
                count = np.random.default_rng([seed, int(no)]).multinomial(k, np.full(shards, 1 / shards))
                first = np.cumsum(count) - count
                draws += [(no, shard, -(-size // block), first[shard], count[shard], k - 1, cut) for shard in np.flatnonzero(count)]
            yield pd.DataFrame(draws, columns=["source_no", "shard", "blocks", "first", "many", "last", "cut"]).astype("int64")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for no, shard, n, lo, hi, last, cut in b[["source_no", "shard", "blocks", "lo", "hi", "last", "cut"]].itertuples(index=False):
                k = np.arange(lo, hi)
                number = np.empty(len(k), np.int64)
                for epoch in np.unique(k // n):
                    own = k // n == epoch
                    number[own] = permute(k[own] % n, n, _seed(seed, no, int(epoch)))
                yield pd.DataFrame({"shard": shard, "source_no": no, "slot": k, "epoch": k // n, "block_no": number, "upto": np.where(k == last, cut, block)})

    kind = "source_no int, shard int, blocks long, first long, many long, last long, cut long"
    counts = sources.where("source_size > 0").select("source_no", "source_size", "target").repartition(parts, "source_no").mapInPandas(draw, kind)
    starts = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1, F.lit(CHUNK)))
    chunks = counts.withColumn("lo", starts).withColumn("hi", F.least(F.col("lo") + CHUNK, F.col("first") + F.col("many")))
    spread = chunks.repartition(parts, "source_no", "shard", "lo")
    return spread.mapInPandas(slots, "shard int, source_no int, slot long, epoch int, block_no long, upto long")


def pieces(packed: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that overlap: words [lo, hi) of the document."""
    end = F.col("start") + F.col("size")
    cut = packed.where("start is not null").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo = F.greatest(F.col("block_no") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block_no") + 1) * block - F.col("start"), F.col("size"))
    return cut.select("row", "source_no", "start", "size", "block_no", lo.alias("lo"), hi.alias("hi"))


def mix(sized: DataFrame, seed: int = 11, block: int = BLOCK, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(packed, taken): all documents in their streams; and the pieces that the mix takes, with shard, slot and epoch.  Input: as ``sizes``."""
    sized = materialise(sized)
    sources = materialise(targets(sized, weights, most))
    by = sources.withColumnRenamed("source", "_source")
    named = sized.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    packed = materialise(pack(named, seed))
    # the plan's size is not known to the optimiser, which would broadcast it
    slots = plan(sources, seed, block, shards).hint("merge")
    got = pieces(packed, block).hint("merge").join(slots, ["source_no", "block_no"])
    upto = F.least("hi", F.col("block_no") * block + F.col("upto") - F.col("start"))
    return packed, got.withColumn("hi", upto).where("lo < hi").drop("upto")


def taken(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    row = free(documents, "__row")
    packed, got = mix(sizes(documents.withColumn(row, F.monotonically_increasing_id()), row), **options)
    amount = got.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    out = packed.join(amount, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of it.

    A document taken whole keeps its text; else the text is its taken words,
    space-joined, in order.  n_chars follows.  Ids repeat, by epoch.
    """
    row, use, ws = (free(documents, f"__{n}") for n in ("row", "use", "words"))
    # written once: the rows' numbers must be the same where texts meet their uses
    numbered = materialise(documents.withColumn(row, F.monotonically_increasing_id()))
    _, got = mix(sizes(numbered, row), **options)
    uses = got.groupBy("row", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    uses = uses.select(F.col("row").alias(row), F.struct("size", "parts").alias(use))
    rows = numbered.join(uses.hint("merge"), row)
    many = F.aggregate(f"{use}.parts", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    cut = F.array_join(F.flatten(F.transform(f"{use}.parts", lambda p: F.slice(ws, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    whole = many == F.col(f"{use}.size")
    rows = rows.withColumn(ws, F.when(~whole, words(F.col("text")))).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns])
