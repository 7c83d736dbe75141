"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks; each pair of blocks is one tile and
one task's group.  Vectors are scaled by powers of two, so that their largest
component lies between 1/2 and 1, and coded as int8.  A tile multiplies codes
(exact in float32, a thousand components at a time) and bounds the error of each product:

    v = a q + e, w = b p + f:  |v.w - ab q.p| <= |aq||f| + |bp||e| + |e||f|

A candidate survives where its upper bound reaches the k-th best lower bound;
survivors are computed again in double precision, and a heap a query keeps the
best.  The bounds leave room for the rounding of the double sums too, and go
back to the vectors' own scale before they are compared, so the result is exact
for all finite vectors.  The heaps of the tiles merge through a rank that is
limited before it is shuffled.

Every candidate visits each block of queries and every query each block of
candidates, which is the method: what is shuffled grows as queries times
candidates over the block sizes.  Vectors travel in their own type.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids; rows of one id count once (the one
with the least hash); vectors of different length never meet; ties go to the
smaller id; an inner product beyond the largest double is infinite, with its
sign, and ties with its like; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK, STRIP = 1024, 4096, 1024
#: Components of a block of vectors at most (a block holds 64 at least), of the pairs computed again at once, and of one exact float32 product.
VALUES, PAIRS, EXACT = 1 << 24, 1 << 20, 1024
_LEAST = np.finfo(np.float64).smallest_subnormal


def sound(vector: Column) -> Column:
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for the fast product), scale, norm of the coded vector and of the error; and the power of two divided by before."""
    power = np.frexp(np.abs(v).max(1))[1]
    v = np.ldexp(v, -power[:, None])
    scale = np.abs(v).max(1) / 127
    code = np.rint(v / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt((coded**2).sum(1)), np.sqrt(((v - coded) ** 2).sum(1)), power


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows of codes: sums of at most EXACT terms below 2**14 fit float32 exactly."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT] @ b[:, i : i + EXACT].T
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in order; rows that could overflow on the way are scaled down and the sum up again."""
    if not len(a):
        return np.zeros(0)
    room = np.frexp(np.abs(a).max(1))[1] + np.frexp(np.abs(b).max(1))[1] + a.shape[1].bit_length() - 1020
    down = np.maximum(room, 0)
    half = down // 2
    if down.any():
        a, b = np.ldexp(a, -half[:, None]), np.ldexp(b, (half - down)[:, None])
    with np.errstate(over="ignore"):
        return np.ldexp(np.cumsum(a * b, axis=1)[:, -1], down)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The best k candidates of each query of one tile."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    qc, qs, qn, qe, qp = quantise(q)
    dim, least = q.shape[1], q.shape[1] * _LEAST
    for at in range(0, len(c), STRIP):
        ids, part = cid[at : at + STRIP], c[at : at + STRIP]
        cc, cs, cn, ce, cp = quantise(part)
        near = product(qc, cc) * qs[:, None] * cs[None, :]
        # the last term: rounding of a sum of dim products, here and when it is computed again
        slack = (qn[:, None] * ce[None, :] + qe[:, None] * cn[None, :] + qe[:, None] * ce[None, :]) * (1 + 1e-9)
        slack += 8 * dim * np.finfo(np.float64).eps * ((qn + qe)[:, None] * (cn + ce)[None, :])
        own, power = qid[:, None] == ids[None, :], qp[:, None] + cp[None, :]
        with np.errstate(over="ignore"):
            low, high = np.ldexp(near - slack, power) - least, np.ldexp(near + slack, power) + least
        low[own] = -np.inf
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(qid), -np.inf)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
        step = max(1, PAIRS // dim)
        for i in range(0, len(rows), step):
            row, col = rows[i : i + step], cols[i : i + step]
            for r, n, s in zip(row.tolist(), ids[col].tolist(), exact(q[row], part[col]).tolist()):
                item = (s, -n)
                if len(heaps[r]) < k:
                    heapq.heappush(heaps[r], item)
                elif item > heaps[r][0]:
                    heapq.heapreplace(heaps[r], item)
    found = [(int(i), -m, s) for i, h in zip(qid, heaps) for s, m in h]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query row by inner product, its own row left out."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & sound(F.col("v").cast("array<double>")))
    rows = rows.groupBy("id").agg(F.min_by(F.struct("v", "asks"), F.xxhash64("v")).alias("r")).select("id", "r.v", "r.asks", F.size("r.v").alias("dim"))
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max("dim")).first()
    fit = max(64, VALUES // max(dim or 1, 1))  # the longer the vectors, the fewer a block holds
    across, down = max(1, math.ceil(n / min(BLOCK, fit))), max(1, math.ceil(asked / min(QUERY_BLOCK, fit)))
    block = F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")
    qblock = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(down)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cands = rows.select("id", "v", "dim", block.alias("c"), every(down).alias("q"))
    asks = rows.where("asks").select("id", "v", "dim", qblock.alias("q"), every(across).alias("c"))

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        right = right.sort_values("id")
        q, c = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (left, right))
        return tile(left["id"].to_numpy(), q, right["id"].to_numpy(), c, k)

    keys = ["dim", "q", "c"]
    got = asks.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(join, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
