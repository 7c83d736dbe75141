"""A trie of conversation prefixes.

A node is a distinct sequence of the first d turns (role and text) of some
conversation; the root has none.

1. Turns are sorted over the whole table by conversation and turn (by range, so
   that a long conversation lies in many partitions), and a numpy scan in each
   partition numbers them and forms rolling prefix fingerprints
   F(d) = F(d-1) + hash(turn d) B**(d-1), modulo two primes of 31 bits.  A
   conversation that goes over partitions gets its earlier parts added: at most as
   many rows as partitions, from the driver.
2. (depth, fingerprint) groups are candidates.  Each member is held against its
   group's representative, the smallest conversation: its turn there must be
   the same and its parent group too, which by induction over the depths is the
   comparison of whole prefixes turn by turn.  Groups with a collision are split by what their members are,
   and the check is run again until none is left.
3. Rollup without walking the levels: a node belongs to its smallest
   conversation, and what a conversation owns is the end of its path.  Each
   node gets the sums of what is owned further down its owner's path, and the totals of all
   other owners whose path goes through it.

Defined cases: null conv_ids take no part; a null role or text counts as empty;
turns of one number follow by role and text, null numbers come first; repeated rows are
turns of their own; an empty table gives no node; extra columns are ignored;
ids that are no whole numbers are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from contentlens.llm.common import materialise, words

PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_013)
#: Ids in a piece of text to be hashed; depths in a block of a path's sums.
CHUNK, STEP = 4096, 1024
_SCANNED = "conv_id long, part int, at long, f1 long, f2 long, g1 long, g2 long, role string, text string"


def _powers(base: int, prime: int, many: int) -> np.ndarray:
    """base**0, base**1, ... modulo prime."""
    out = np.ones(1, np.int64)
    while len(out) < many:
        out = np.concatenate([out, out * (pow(base, len(out), prime)) % prime])
    return out[:many]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted partition: number of each turn in its conversation and the fingerprints up to it (f) and before it (g)."""
    part, last, count, carried = TaskContext.get().partitionId(), None, 0, [0, 0]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_numpy()
        start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
        index = np.arange(n) - start[of]
        goes_on = last is not None and conv[0] == last
        before = np.where(of == 0, count if goes_on else 0, 0)
        columns = []
        for k, (p, base) in enumerate(zip(PRIMES, BASES)):
            t = b.column(1 + k).to_numpy() % p
            term = t * _powers(base, p, n)[index] % p
            if goes_on:
                term = np.where(of == 0, term * pow(base, count, p) % p, term)
            total = np.cumsum(term)
            base_of = (total - term)[start]
            base_of[0] -= carried[k] if goes_on else 0
            f = (total - base_of[of]) % p
            columns += [f, (f - term) % p]
            carried[k] = int(f[-1])
        at = index + before + 1
        last, count = conv[-1], int(at[-1])
        f1, g1, f2, g2 = map(pa.array, columns)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at), f1, f2, g1, g2, b.column(3), b.column(4)],
            ["conv_id", "part", "at", "f1", "f2", "g1", "g2", "role", "text"],
        )


def _carries(scanned: DataFrame) -> list[tuple]:
    """For each part, but the first, of a conversation that goes over partitions: turns and fingerprints before it, powers of the bases to these turns."""
    parts = scanned.groupBy("conv_id", "part").agg(F.max(F.struct("at", "f1", "f2")).alias("end"))
    over = parts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "end")).alias("parts")).where(F.size("parts") > 1)
    out = []
    for r in over.collect():  # at most two rows for each partition
        n, f = 0, [0, 0]
        for x in sorted(r.parts, key=lambda x: x.part):
            power = [pow(b, n, p) for p, b in zip(PRIMES, BASES)]
            if n:
                out.append((r.conv_id, x.part, n, *f, *power))
            f = [(a + w * v) % p for a, w, v, p in zip(f, power, (x.end.f1, x.end.f2), PRIMES)]
            n += x.end.at
    return out


def fingerprinted(turns: DataFrame) -> DataFrame:
    """conv_id, d (from 1), f and g (fingerprints up to the turn, before it), role, text; written to the shared folder.

    turns is best a table or what materialise() gives: it is read twice, once to find the ranges.
    """
    if not isinstance(turns.schema["conv_id"].dataType, IntegralType):
        raise TypeError("conv_id must be a whole number")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "__n"]  # the number spreads equal rows over partitions
    rows = rows.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", *[F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(p)).alias(f"t{k}") for k, p in enumerate(PRIMES)], "role", "text")
    scanned = materialise(rows.mapInArrow(_scan, _SCANNED))
    carries = _carries(scanned)
    at, prints = F.col("at"), {c: F.col(c) for c in ("f1", "f2", "g1", "g2")}
    if carries:
        known = turns.sparkSession.createDataFrame(carries, "conv_id long, part int, n long, c1 long, c2 long, p1 long, p2 long")
        scanned = scanned.join(F.broadcast(known), ["conv_id", "part"], "left")
        at = at + F.coalesce("n", F.lit(0))
        for name, c in prints.items():
            k = int(name[1])
            prints[name] = F.when(F.col("n").isNull(), c).otherwise((F.col(f"c{k}") + F.col(f"p{k}") * c) % PRIMES[k - 1])
    both = lambda x: (prints[f"{x}1"] * F.lit(1 << 31).cast("long") + prints[f"{x}2"]).alias(x)
    return scanned.select("conv_id", at.alias("d"), both("f"), both("g"), "role", "text")


def shared_heads(turns: DataFrame, base: Column, many: Column) -> DataFrame:
    """conv_id, turn, role, text: conversations that begin with the first ``many`` turns of conversation ``base`` and go on with their own after as many.

    base and many are of conv_id, many at most 3 or so; turns are numbered anew, without gaps.
    """
    rows = materialise(fingerprinted(turns).select("conv_id", "d", "role", "text"))
    plan = rows.select("conv_id").distinct().select("conv_id", base.alias("base"), many.alias("many"))
    most = plan.agg(F.max("many")).first()[0] or 0
    heads = rows.where(F.col("d") <= most)
    given = heads.withColumnRenamed("conv_id", "base").join(plan, "base").where(F.col("d") <= F.col("many"))
    length = heads.groupBy("conv_id").agg(F.max("d").alias("n")).withColumnRenamed("conv_id", "base")
    plan = plan.join(length, "base", "left").select("conv_id", "many", F.least("many", F.coalesce("n", F.lit(0))).alias("given"))
    own = rows.join(plan, "conv_id").where(F.col("d") > F.col("many"))
    own = own.select("conv_id", (F.col("d") - F.col("many") + F.col("given")).alias("turn"), "role", "text")
    return materialise(given.select("conv_id", F.col("d").alias("turn"), "role", "text").unionByName(own))


def _split(rows: DataFrame) -> DataFrame | None:
    """Holds every member against its group's representative; rows with groups split where some differ, or None."""
    key = ["d", "f", "v"]
    groups = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    model = rows.join(groups, [*key, "conv_id"]).select(*key, F.struct("g", "pv", "role", "text").alias("model"))
    # not made distinct here, so that AQE can split the join of a large group
    bad = materialise(rows.join(model, key).where(F.struct("g", "pv", "role", "text") != F.col("model")).select(*key))
    if bad.isEmpty():
        return None
    own = [*key, "g", "pv", "role", "text"]
    mixed = rows.join(bad, key, "left_semi")
    named = mixed.groupBy(*own).agg(F.min("conv_id").cast("string").alias("now"))
    changed = materialise(mixed.join(named, own).select("conv_id", "d", "now"))
    below = changed.select("conv_id", (F.col("d") + 1).alias("d"), F.col("now").alias("above"))
    rows = rows.join(changed, ["conv_id", "d"], "left").join(below, ["conv_id", "d"], "left")
    new = {"v": F.coalesce("now", "v"), "pv": F.coalesce("above", "pv")}
    return materialise(rows.withColumns(new).drop("now", "above"))


def verified(rows: DataFrame) -> DataFrame:
    """Adds v and pv, which tell apart the groups of one depth and fingerprint, of a turn and of the one before it; empty but for collisions."""
    rows = materialise(rows.withColumns({"v": F.lit(""), "pv": F.lit("")}))
    while (split := _split(rows)) is not None:
        rows = split
    return rows


def _further(tree: DataFrame) -> DataFrame:
    """conv_id, d, and sums of saved and leaf over its owner's nodes from d on; long paths by blocks of depths."""
    rows = tree.select("conv_id", "d", "saved", "leaf").withColumn("b", F.floor(F.col("d") / STEP))
    down = W.partitionBy("conv_id", "b").orderBy(F.desc("d"))
    below = W.partitionBy("conv_id").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "b").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    blocks = blocks.select("conv_id", "b", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("s", "l")])
    rows = rows.select("conv_id", "d", "b", *[F.sum(c).over(down).alias(c) for c in ("saved", "leaf")]).join(blocks, ["conv_id", "b"])
    return rows.select("conv_id", "d", (F.col("saved") + F.col("s")).alias("saved_on"), (F.col("leaf") + F.col("l")).alias("leaves_on"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, d, conv_id) as pieces of comma-joined ids; what a batch completes leaves together."""
    part, seq, key, held, out = TaskContext.get().partitionId(), 0, None, [], []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["node", "d", "part", "seq", "ids"])

    for b in batches:
        out = []
        for node, d, c in zip(b["node"].tolist(), b["d"].tolist(), b["conv_id"].tolist()):
            if key != (node, d) or len(held) == CHUNK:
                if held:
                    out.append((*key, part, seq, ",".join(held)))
                    seq += 1
                key, held = (node, d), []
            held.append(str(c))
        yield frame()
    out = [(*key, part, seq, ",".join(held))] if held else []
    yield frame()


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces as one SHA-256 a node, which takes up piece after piece."""
    key, sha, out = None, None, []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["node", "d", "ends_sha256"])

    for b in batches:
        out = []
        for node, d, ids in zip(b["node"].tolist(), b["d"].tolist(), b["ids"].tolist()):
            if key != (node, d):
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (node, d), hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield frame()
    out = [(*key, sha.hexdigest())] if key is not None else []
    yield frame()


def _end_hashes(ends: DataFrame) -> DataFrame:
    order, pieces = ["node", "d", "conv_id"], ["node", "d", "part", "seq"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_chunks, "node long, d long, part int, seq long, ids string")
    return cut.repartition("node", "d").sortWithinPartitions(*pieces).mapInPandas(_hashes, "node long, d long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row for each node: conv_id (its smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text.  conversations: conv_id of all, where some have no turns.
    """
    ids = (turns if conversations is None else conversations).where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = verified(fingerprinted(turns))
    key = ["d", "f", "v"]
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last"))
    ends = materialise(ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{c}", z).alias(c) for c, z in zip(key, (F.lit(0), F.lit(0), F.lit("")))]))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("conv_id", "g", "pv")).alias("own"))
    top = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = top.select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("f"), F.lit("").alias("v"), "n_convs", "conv_id", F.lit(None).cast("long").alias("g"), F.lit(None).cast("string").alias("pv"))
    nodes = materialise(groups.select(*key, "n_convs", "own.*").unionByName(root))
    # the words of a node's last text count only where several conversations share it
    shared = rows.join(nodes.where("n_convs > 1 and d > 0").select(*key, "conv_id"), [*key, "conv_id"]).select(*key, F.size(words(F.col("text"))).cast("long").alias("words"))
    up = nodes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("g").alias("f"), F.col("pv").alias("v"))
    many = up.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("f").alias("g"), F.col("v").alias("pv"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(shared, key, "left").join(many, key, "left").join(above, ["d", "g", "pv"], "left")
    children = F.coalesce("n_children", F.lit(0)).cast("long")
    tree = materialise(tree.select(
        *key, "conv_id", "parent_conv_id", "n_convs", children.alias("n_children"),
        F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0)).cast("long").alias("saved"), (children == 0).cast("long").alias("leaf"),
    ))
    owners = tree.groupBy("conv_id").agg(F.min("d").alias("since"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    paths = rows.select("conv_id", *key).unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("f"), F.lit("").alias("v")))
    through = paths.join(owners, "conv_id").where("d < since").groupBy(*key).agg(F.sum("saved").alias("saved_by"), F.sum("leaf").alias("leaves_by"))
    hashes = _end_hashes(ends.join(tree.select(*key, F.col("conv_id").alias("node")), key))
    out = tree.join(_further(tree), ["conv_id", "d"]).join(through, key, "left").join(hashes.withColumnRenamed("node", "conv_id"), ["conv_id", "d"], "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_on") + F.coalesce("leaves_by", F.lit(0))).alias("n_leaves"),
        (F.col("saved_on") + F.coalesce("saved_by", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
