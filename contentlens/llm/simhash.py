"""SimHash near-duplicates, linked through a forest of vantage-point trees.

Fingerprints: lower-cased A-Z, words, 3-word shingles with repeats, XXH64 (seed
42), majority per bit.  Two fingerprints link at 3 or fewer differing bits.

A pair within 3 bits agrees in one of its two 32-bit halves up to 1 bit, so the
metric that each tree uses is the Hamming distance of one half, and its search
radius is 1: at 64 bits and radius 3 the triangle bounds would prune far less.
The top of a tree is fitted on a bounded sample and deals distinct fingerprints
to shards; a fingerprint also visits each neighbouring shard that its ball
overlaps.  Within a shard the tree goes on, and what is left is compared
exactly over all 64 bits.  A shard gives a spanning forest of its links, which
keeps all components; groups of copies are never expanded into pairs.

A fingerprint visits both sides of a node that its ball overlaps, about 28 in
100 on each of the log2(n / SHARD) levels: it is the price of the method that
the visits grow as n to the power 1.36.  What one shard is home to does not grow.

Defined cases: a null text counts as empty; texts without words have the
fingerprint zero and link like any other; repeated rows share a class; rows
with a null id join classes but never name one (a class of such rows only has
a null component_id); an empty table gives an empty result; ids can be of any
type that has an order; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from contentlens.llm.common import free, materialise
from contentlens.llm.components import components

RADIUS, HALF_RADIUS, SHINGLE = 3, 1, 3
#: Distinct fingerprints that a shard is home to, the most sampled to fit the top of a tree, and the size at which search stops splitting.
SHARD, SAMPLE, LEAF = 4096, 1 << 16, 512
#: Levels of a tree that are fitted to the sample, which bounds what is broadcast; deeper nodes take their vantage points from a hash of their number.
FITTED, MIDDLE = 16, 15
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    ws = (text or "").encode("utf-8").lower().split()
    n = len(ws) - SHINGLE + 1
    if not ws:
        return 0
    if n < 1:
        n, whole, starts, ends = 1, b" ".join(ws), [0], [1 << 60]
    else:
        whole = b" ".join(ws)
        stop = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts, ends = [0, *(stop[: n - 1] + 1).tolist()], stop[SHINGLE - 1 :].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = np.fromiter((h(whole[s:e], 42) for s, e in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])), np.uint64, min(_BLOCK, n - i))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in text:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


fingerprints = _fingerprints.asNondeterministic()  # evaluated once


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _half(fp: np.ndarray, which: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * which)).astype(np.uint32)


def _split(half: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
    """A vantage point and radius: near the median, with the least of the sample at the boundary."""
    best = None
    for v in half[rng.integers(0, len(half), 6)]:
        d = np.bitwise_count(half ^ v)
        mu = int(np.median(d))
        for m in (mu - 1, mu):
            inside = float((d <= m).mean())
            cost = float(((d == m) | (d == m + 1)).mean()) + 2 * abs(inside - 0.5)
            if best is None or cost < best[0]:
                best = (cost, int(v), m)
    return best[1], best[2]


def fit_tree(sample: np.ndarray, depth: int, seed: int = 1) -> np.ndarray:
    """Vantage point and radius of each inner node of a full binary tree, in heap order."""
    rng, nodes, members = np.random.default_rng(seed), np.zeros((2**depth, 2), np.int64), {1: sample}
    for k in range(1, 2**depth):
        own = members.pop(k, sample)
        v, m = _split(own if len(own) >= 16 else sample, rng)
        nodes[k] = v, m
        inside = np.bitwise_count(own ^ np.uint32(v)) <= m
        members[2 * k], members[2 * k + 1] = own[inside], own[~inside]
    return nodes


def node(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of nodes, by number."""
    mixed = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    inner = np.minimum(at, len(nodes) - 1)
    fitted = at < len(nodes)
    return np.where(fitted, nodes[inner, 0], mixed.astype(np.int64)).astype(np.uint32), np.where(fitted, nodes[inner, 1], MIDDLE)


def place(half: np.ndarray, nodes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for the home shard of each row and for all that its ball overlaps."""
    row, at, home = np.arange(len(half)), np.ones(len(half), np.int64), np.ones(len(half), bool)
    for _ in range(depth):
        v, m = node(nodes, at)
        d = np.bitwise_count(half[row] ^ v).astype(np.int64)
        to_in, to_out = d - HALF_RADIUS <= m, d + HALF_RADIUS > m
        row = np.concatenate([row[to_in], row[to_out]])
        home = np.concatenate([(home & (d <= m))[to_in], (home & (d > m))[to_out]])
        at = np.concatenate([2 * at[to_in], 2 * at[to_out] + 1])
    return row, at, home


def _search(home: np.ndarray, visit: np.ndarray, which: int, rng: np.random.Generator, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (home, visiting) of fingerprints within RADIUS bits: goes down the tree, then compares."""
    if len(home) > LEAF and depth < 24:
        hh, hv = _half(home, which), _half(visit, which)
        v, m = _split(hh[rng.integers(0, len(hh), 1024)], rng)
        dh, dv = np.bitwise_count(hh ^ np.uint32(v)).astype(int), np.bitwise_count(hv ^ np.uint32(v)).astype(int)
        inside = dh <= m
        if 0 < inside.sum() < len(home):
            yield from _search(home[inside], visit[dv - HALF_RADIUS <= m], which, rng, depth + 1)
            yield from _search(home[~inside], visit[dv + HALF_RADIUS > m], which, rng, depth + 1)
            return
    for i in range(0, len(home), 512):
        for j in range(0, len(visit), 4096):
            near = np.bitwise_count(home[i : i + 512, None].view(np.uint64) ^ visit[None, j : j + 4096].view(np.uint64)) <= RADIUS
            a, b = np.nonzero(near)
            if len(a):
                yield home[i + a], visit[j + b]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root: dict[int, int] = {}
    kept = []

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for xs, ys in pairs:
        other = xs != ys
        for x, y in zip(xs[other].tolist(), ys[other].tolist()):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((x, y))
    return kept


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within RADIUS bits; input: a column fp of distinct fingerprints."""
    spark, n = distinct.sparkSession, distinct.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / SHARD)))
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE if depth else 1).collect()], np.int64)
    trees = spark.sparkContext.broadcast([fit_tree(_half(sample, w), min(depth, FITTED), w + 1) for w in (0, 1)])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for which in (0, 1):
                row, at, home = place(_half(fp, which), trees.value[which], depth)
                yield pd.DataFrame({"shard": 2 * at + which, "fp": fp[row], "home": home})

    def pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp, home = group["fp"].to_numpy(np.int64), group["home"].to_numpy(bool)
        found = forest(_search(fp[home], fp, int(key[0]) % 2, np.random.default_rng(5)))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    dealt = distinct.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(pairs, "a long, b long")


def _rooted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marked, named): doc_id, fp and two hashes of id and text for each row; and fp, root (nameless, id, fp) for each fingerprint.

    Fingerprints are ordered by the least id of their documents, so the root of
    a component holds its name and nothing is joined by class.  Those of rows
    with null ids only come after all ids.
    """
    key = [F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull(), F.lit(k)).alias(f"k{k}") for k in (1, 2)]
    marked = materialise(documents.select("doc_id", fingerprints("text").alias("fp"), *key))
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("id"))
    distinct = materialise(own.select("fp", F.struct(F.col("id").isNull().alias("nameless"), "id", "fp").alias("node")))
    node = lambda c: distinct.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    edges = links(distinct).join(node("a"), "a").join(node("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = components(edges)
    return marked, distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked, named = _rooted(documents)
    return marked.join(named, "fp").select("doc_id", "fp", F.col("root.id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class, with all columns: the one least by id, nulls last, then by a hash of id and text."""
    marked, named = _rooted(documents)
    first = marked.join(named, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("f"))
    k1, k2 = (free(documents, n) for n in ("__k1", "__k2"))
    keys = first.select(F.col("f.k1").alias(k1), F.col("f.k2").alias(k2))
    rows = documents.withColumns({n: F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull(), F.lit(k)) for k, n in ((1, k1), (2, k2))})
    kept = rows.join(keys, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
