"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

The second-order term is the sum-of-squares identity, so a document costs time
linear in its non-zero features.  The model is fitted on a bounded sample of
labelled rows (``max_train``); scoring covers every whole text.

Defined cases: a null text scores like the empty text; with no labels, or one
class only, every score is the (smoothed) share of label 1; ties in the sample
order fall to the smaller id; repeated label rows of one id count once, with
the higher label; of documents that share an id, the one whose text and length
hash least is learned from, whatever the order of rows, and all are scored; ids may be of any type.  Extra columns pass through untouched, but for one named as
a result, which is replaced: name another by ``score`` and ``predicted``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.llm.common import held_out

BUCKETS = 1 << 14
#: Places of the structure statistics and of the one metadata value, after the word buckets.
STRUCTURE = (
    "bias_short", "upper", "symbol", "digit", "space", "distinct_words", "word_length", "lines",
    "pipe", "bang", "top_word", "long_word", "repeat_line", "log_chars",
)
WIDTH = BUCKETS + len(STRUCTURE)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        pair = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        y = self.bias + float(self.linear[at] @ x) + pair
        return 1 / (1 + float(np.exp(-np.clip(y, -30, 30))))


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature places and values of one document."""
    text = text or ""
    raw = text.encode("utf-8")
    tokens = raw.split()
    count = Counter(tokens)
    total, chars = max(len(tokens), 1), max(len(text), 1)
    bytes_in = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    size = max(len(raw), 1)
    upper = bytes_in[65:91].sum() / size
    digit = bytes_in[48:58].sum() / size
    space = (bytes_in[9:14].sum() + bytes_in[32]) / size
    symbol = (bytes_in[33:48].sum() + bytes_in[58:65].sum() + bytes_in[91:97].sum() + bytes_in[123:127].sum()) / size
    lines = text.split("\n")
    extra = [
        1.0 if total < 20 else 0.0, 4 * upper, 6 * symbol, 6 * digit, 2 * space, len(count) / total,
        min(len(raw) / total / 12, 3), min(5 * len(lines) / total, 2), 4 * bytes_in[124] / total, 2 * bytes_in[33] / total,
        3 * max(count.values(), default=0) / total, min(max(map(len, count), default=0) / 60, 2),
        1 - len(set(lines)) / len(lines), np.log1p(n_chars if n_chars is not None and n_chars == n_chars else chars) / 12,
    ]
    at = np.fromiter((zlib.crc32(w.lower()) % BUCKETS for w in count), np.int64, len(count))
    x = np.fromiter(count.values(), np.float64, len(count))
    if len(x):
        x = np.sqrt(x)
        # words of one bucket are one feature: the pair term must not count it against itself
        at, same = np.unique(at, return_inverse=True)
        x = np.bincount(same, weights=x)
        x /= np.sqrt((x**2).sum())
    return np.concatenate([at, np.arange(BUCKETS, WIDTH)]), np.concatenate([x, np.array(extra, np.float64)])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, one document a step."""
    rng = np.random.default_rng(seed)
    ones = sum(y for *_, y in rows)
    share = (ones + 1) / (len(rows) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, rank)))
    if not rows or ones in (0, len(rows)):
        m.factors[:] = 0
        return m
    g0, gw, gv = 1e-8, np.full(WIDTH, 1e-8), np.full((WIDTH, rank), 1e-8)
    rate *= 5
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            v = m.factors[at]
            vx = v * x[:, None]
            s = vx.sum(0)
            z = m.bias + m.linear[at] @ x + 0.5 * (s @ s - (vx**2).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g0 += e * e
            m.bias -= rate * e / np.sqrt(g0)
            dw = e * x + decay * m.linear[at]
            dv = e * (x[:, None] * s - v * (x**2)[:, None]) + decay * v
            gw[at] += dw * dw
            gv[at] += dv * dv
            m.linear[at] -= rate * dw / np.sqrt(gw[at])
            m.factors[at] -= rate * dv / np.sqrt(gv[at])
    return m


def fit(documents: DataFrame, labels: DataFrame, max_train: int = 3000) -> Machine:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold, chosen by hash of the id."""
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # broadcast: at most max_train (id, label) rows
    rows = documents.select("doc_id", "text", "n_chars").join(F.broadcast(picked), "doc_id")
    # one row an id, by aggregation: no more than max_train reach the driver
    one = F.min_by(F.struct("text", "n_chars", "_quality"), F.xxhash64("text", F.col("n_chars").cast("double")))
    rows = rows.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [features(t, n) for t, n in zip(b["text"], b["n_chars"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["_quality"], "at": [p[0] for p in pairs], "x": [p[1] for p in pairs]})

    of = documents.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(encode, f"doc_id {of}, y int, at array<long>, x array<double>").toPandas().sort_values("doc_id")
    return train([(np.asarray(a, np.int64), np.asarray(x, np.float64), int(y)) for a, x, y in zip(got["at"], got["x"], got["y"])])


def scorer(spark: SparkSession, machine: Machine):
    """A pandas UDF (text, n_chars) -> score."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, n in parts:
            yield pd.Series([shared.value.score(*features(t, c)) for t, c in zip(text, n)], dtype="float64")

    return score.asNondeterministic()  # keeps Spark from evaluating it twice


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 3000, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold) to all documents, under the names given."""
    udf = scorer(documents.sparkSession, fit(documents, labels, max_train))
    out = documents.withColumn(score, udf("text", F.col("n_chars").cast("double")))
    return out.withColumn(predicted, _predicted(F.col(score), threshold))


def _predicted(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
