"""State that expires: progress of batches, and a cache of results by tier.

Both use transformWithState with a time to live (processing time; it needs the RocksDB state store): an expired key leaves
the store and, seen again, starts anew.  Such a query runs batches without data as long as it lives; to let an available-now trigger
end, set spark.sql.streaming.noDataMicroBatches.enabled to false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds: a batch's items, and a cached result by the tier that stored it (fixed values).
BATCH_TTL = 86_400
CACHE_TTL = {"anonymous": 3_600, "free": 86_400, "pro": 604_800, "enterprise": 2_592_000}


class _Batches(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "done long, failed long, told boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, failed, told = self.state.get() if self.state.exists() else (0, 0, False)
        total = 0
        for p in rows:
            done += int((p["status"] == "done").sum())
            failed += int((p["status"] == "failed").sum())
            total = max(total, int(p["total"].max()))
        complete = done + failed >= total
        if complete and not told:
            yield pd.DataFrame({"batch_id": [key[0]], "done": [done], "failed": [failed]})
        self.state.update((done, failed, told or complete))

    def close(self) -> None:
        pass


def batch_completion(stream: DataFrame, ttl: float = BATCH_TTL) -> DataFrame:
    """One row a batch, when done and failed first reach its total.  Input: batch_id, total, status.  A batch is forgotten ``ttl`` seconds after its last item."""
    rows = stream.where("batch_id is not null").select(F.col("batch_id").cast("long").alias("batch_id"), F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"), "status")
    return rows.groupBy("batch_id").transformWithStateInPandas(_Batches(int(ttl * 1000)), "batch_id long, done long, failed long", "Append", "ProcessingTime")


class _Cache(StatefulProcessor):
    """A value state for each tier, as a time to live is a state's own."""

    def __init__(self, ttl: dict[str, float]):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {t: handle.getValueState(t, "score double, at long", ttlDurationMs=int(s * 1000)) for t, s in self.ttl.items()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got, out = pd.concat(list(rows)).sort_values(["ms", "request_id"]), []
        held = next(((t, *s.get()) for t, s in self.states.items() if s.exists()), None)
        new = None
        for request, tier, ms, score in zip(got["request_id"].tolist(), got["tier"].tolist(), got["ms"].tolist(), got["score"].tolist()):
            tier = tier if tier in self.ttl else "free"
            left = held[2] + int(self.ttl[held[0]] * 1000) - ms if held else 0
            if left > 0:
                out.append((request, key[0], True, held[1], left // 1000))
            else:  # a miss: the result is worked out and stored under this tier
                held = new = (tier, score, ms)
                out.append((request, key[0], False, score, int(self.ttl[tier])))
        if new:
            for t, s in self.states.items():
                s.update(new[1:]) if t == new[0] else s.clear()
        yield pd.DataFrame(out, columns=["request_id", "content_hash", "hit", "score", "ttl_remaining"])

    def close(self) -> None:
        pass


def cached_results(stream: DataFrame, ttl: dict[str, float] | None = None) -> DataFrame:
    """Whether each request found a result, the result, and the seconds that it has left.

    Input: request_id, content_hash, tier, ts, score (what a miss works out and stores).  A hit does not lengthen a result's life.  An unknown
    tier counts as free.  By the requests' own times a result is dead after its tier's time; by the clock its state goes after as long.
    """
    rows = stream.where("content_hash is not null and ts is not null").select("request_id", "content_hash", "tier", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("score").cast("double").alias("score"))
    out = "request_id long, content_hash string, hit boolean, score double, ttl_remaining long"
    return rows.groupBy("content_hash").transformWithStateInPandas(_Cache(ttl or CACHE_TTL), out, "Append", "ProcessingTime")
