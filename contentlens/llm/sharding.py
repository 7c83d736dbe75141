"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``SLOTS`` places; each shard stands at ``VNODES`` of them.  A key
goes to the place of its hash and on clockwise to the next shard.  Shards have
exact quotas (row counts at most one apart: the law ``rows``); keys that find a
shard full go on clockwise to the next that has room.  Shards accept in rounds,
by hops, then by place; within a place keys are numbered by a hash of the whole
row, so the outcome does not depend on the order of input.

Only counts per place are needed to see how far each place's keys go: one
bounded table of SLOTS rows, whatever the input.  The keys themselves are
numbered within their place and looked up in the plan; places are cut into
parts by that hash, of which there are more the more rows there are, so that
one key with a large share of the rows is numbered by several tasks.

Defined cases: a null text has size 1 and crc 0; null ids hash to one place;
repeated rows are rows of their own; an empty table gives an empty result;
with fewer rows than shards, some shards stay empty; rows that differ only in
columns of types without a hash (maps) may change places between runs.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.llm.common import hashable, materialise

SLOTS, VNODES = 4096, 64
#: Parts of a place at least, and rows for which the parts double.
SALTS, PART = 8, 1 << 22


def preferences(shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[list[int]]:
    """For each place of the ring, all shards in clockwise order."""
    stands: dict[int, list[int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            stands.setdefault(zlib.crc32(f"shard {s} node {v}".encode()) % slots, []).append(s)
    out: list[list[int]] = [[] for _ in range(slots)]
    ahead: list[int] = []  # shards clockwise of the place, nearest first
    for place in range(2 * slots - 1, -1, -1):
        here = sorted(set(stands.get(place % slots, [])))  # two nodes of a shard can share a place
        if here:
            ahead = here + [s for s in ahead if s not in here]
        if place < slots:
            out[place] = list(ahead)
    return out


def assign(counts: dict[int, int], shards: int) -> list[dict]:
    """Runs of each place's keys: [lo, hi) of the place go to shard, from number base on."""
    total, prefer = sum(counts.values()), preferences(shards)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    left, taken, used, runs = dict(counts), dict.fromkeys(counts, 0), [0] * shards, []
    for hop in range(shards):
        for place in sorted(left):
            s = prefer[place][hop]
            k = min(left[place], room[s])
            if k:
                runs.append({"p": place, "s": s, "lo": taken[place], "hi": taken[place] + k, "base": used[s]})
                room[s] -= k
                used[s] += k
                taken[place] += k
                left[place] -= k
        left = {p: n for p, n in left.items() if n}
    if left:
        raise RuntimeError("the ring has no room left")  # cannot be: quotas add up to the rows
    return runs


def shard_rows(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = materialise(
        documents.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("place"),
            *[F.xxhash64(*[F.col(f"`{c}`") for c in hashable(documents)], F.lit(k)).alias(f"h{k}") for k in (1, 2)],
        )
    )
    salts = max(SALTS, -(-rows.count() // PART))
    # parts follow the hash, so that the parts' order and the order within them are one order
    rows = rows.withColumn("salt", F.floor(F.shiftrightunsigned("h1", 33) * F.lit(salts) / F.lit(float(1 << 31))).cast("int"))
    counts = rows.groupBy("place", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("place").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("place", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    runs = assign({r["place"]: r["n"] for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}, shards)
    kind = "array<struct<p:int,s:int,lo:bigint,hi:bigint,base:bigint>>"
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), kind)))
    # by the hash as an unsigned number, as the parts are
    number = F.row_number().over(W.partitionBy("place", "salt").orderBy(F.shiftrightunsigned("h1", 33), "h1", "h2")) - 1
    # broadcast of the plan: SLOTS rows with a few more where a place is cut; the offsets are a row a part
    placed = rows.withColumn("number", number).join(offsets, ["place", "salt"]).withColumn("k", F.col("number") + F.col("before"))
    out = placed.join(F.broadcast(plan), (F.col("place") == F.col("p")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").alias("shard"),
        (F.col("base") + F.col("k") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
