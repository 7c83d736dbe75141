"""Call sessions: start, frames, end or silence; frames cut again into chunks of half a second; a summary at the close.

``sessions`` is the stream (transformWithState: value state, list states, event-time timers; it needs the RocksDB
state store), ``summaries`` the same over a table.  Frames of a call come in order of time and frame number, within a batch in any order.

A frame has a length in milliseconds and a score.  A call's frames are joined and
cut every CHUNK milliseconds; a chunk's score is the mean over its time, what is left at the close is dropped.
A window of the last WINDOW chunk scores is averaged, c = .85 c + .15 m from 0, and a call is
flagged once m is at least THRESHOLD.

Defined cases: a frame without a session starts one, a "start" closes an open one first, as does
silence of SILENCE milliseconds or more; "end" closes after its frame; frames of no length count for the times only; null lengths
and such below 0 count as 0, null scores as 0.5 and null frame numbers come first; rows without a call or a time take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK, WINDOW, SILENCE, THRESHOLD, DECAY = 500, 4, 1_800_000, 0.75, 0.85
#: Parts of chunks that a task of the batch twin sorts.
PARTS = 500_000
SUMMARY = "call_id long, started_ms long, duration_ms long, chunks long, flagged boolean, final_score double"


def _clean(frames: DataFrame) -> DataFrame:
    """call_id, seq, kind, ms, len, score, ts."""
    return frames.where("call_id is not null and ts is not null").select(
        F.col("call_id").cast("long").alias("call_id"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"), F.coalesce("kind", F.lit("frame")).alias("kind"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.greatest(F.col("len").cast("long"), F.lit(0)).alias("len"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.5)).alias("score"), F.col("ts").cast("timestamp").alias("ts"),
    )


class _Calls(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "started long, last long, chunks long, flagged boolean, mean double")
        self.rest = handle.getListState("rest", "len long, score double")
        self.window = handle.getListState("window", "score double")

    def _load(self) -> None:
        self.now = list(self.call.get()) if self.call.exists() else None
        self.parts = [list(x) for x in self.rest.get()] if self.rest.exists() else []
        self.held = sum(n for n, _ in self.parts)
        self.scores = [x[0] for x in self.window.get()] if self.window.exists() else []

    def _save(self) -> None:
        if self.now is None:
            for state in (self.call, self.rest, self.window):
                state.clear()
            return
        self.call.update(tuple(self.now))
        for state, rows in ((self.rest, [tuple(p) for p in self.parts]), (self.window, [(s,) for s in self.scores])):
            state.put(rows) if rows else state.clear()

    def _close(self, key: tuple) -> tuple:
        started, last, chunks, flagged, mean = self.now
        self.now, self.parts, self.held, self.scores = None, [], 0, []
        return (key[0], started, last - started, chunks, flagged, mean)

    def _hear(self, length: int, score: float) -> None:
        """Adds a frame and takes off the chunks that it completes."""
        if length > 0:
            self.parts.append([length, score])
            self.held += length
        while self.held >= CHUNK:
            need, total = CHUNK, 0.0
            while need:
                n = min(need, self.parts[0][0])
                total += n * self.parts[0][1]
                need -= n
                self.parts[0][0] -= n
                if not self.parts[0][0]:
                    self.parts.pop(0)
            self.held -= CHUNK
            self.scores = [*self.scores, total / CHUNK][-WINDOW:]
            m = sum(self.scores) / len(self.scores)
            self.now[2] += 1
            self.now[3] = self.now[3] or m >= THRESHOLD
            self.now[4] = DECAY * self.now[4] + (1 - DECAY) * m

    def _timer(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if self.now is not None:
            self.handle.registerTimer(self.now[1] + SILENCE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        got, closed = pd.concat(list(rows)).sort_values(["ms", "seq"]), []
        for kind, ms, length, score in zip(got["kind"].tolist(), got["ms"].tolist(), got["len"].tolist(), got["score"].tolist()):
            if self.now is not None and (kind == "start" or ms - self.now[1] >= SILENCE):
                closed.append(self._close(key))
            if self.now is None:
                self.now = [ms, ms, 0, False, 0.0]
            self.now[1] = ms
            self._hear(length, score)
            if kind == "end":
                closed.append(self._close(key))
        self._save()
        self._timer()
        yield _frame(closed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        closed = []
        if self.now is not None and self.now[1] + SILENCE <= expiredTimerInfo.getExpiryTimeInMs():
            closed.append(self._close(key))
            self._save()
        yield _frame(closed)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["call_id", "started_ms", "duration_ms", "chunks", "flagged", "final_score"]).astype({"call_id": "int64", "started_ms": "int64", "duration_ms": "int64", "chunks": "int64", "flagged": "bool", "final_score": "float64"})


def sessions(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Summaries of closed sessions.  Input: call_id, seq, kind, ts, len, score."""
    rows = _clean(stream).withWatermark("ts", late)
    return rows.groupBy("call_id").transformWithStateInPandas(_Calls(), SUMMARY, "Append", "EventTime")


def summaries(frames: DataFrame) -> DataFrame:
    """The summaries of all sessions of a table of frames.

    A task sorts twice, its calls' frames and the parts of their chunks, and groups nothing; it has some PARTS parts, so there are more tasks for a larger table.
    """
    frames = _clean(frames)
    parts = frames.agg(F.sum(1 + F.col("len") / CHUNK)).first()[0] or 0
    w = W.partitionBy("call_id").orderBy("ms", "seq")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    begins = (F.col("kind") == "start") | F.coalesce(F.lag("kind").over(w) == "end", F.lit(False)) | F.coalesce(F.col("ms") - F.lag("ms").over(w) >= SILENCE, F.lit(True))
    rows = frames.repartition(max(frames.sparkSession.sparkContext.defaultParallelism, math.ceil(parts / PARTS)), "call_id").select("call_id", "seq", "ms", "len", "score", begins.alias("new"))
    rows = rows.withColumns({"session": F.sum(F.col("new").cast("int")).over(so_far), "started_ms": F.last(F.when(F.col("new"), F.col("ms")), True).over(so_far), "closing": F.coalesce(F.lead("new").over(w), F.lit(True)), "off": F.sum("len").over(so_far) - F.col("len")})
    rows = rows.withColumn("off", F.col("off") - F.last(F.when(F.col("new"), F.col("off")), True).over(so_far))
    key = ["call_id", "session"]
    first, last = F.floor(F.col("off") / CHUNK), F.floor((F.col("off") + F.col("len") - 1) / CHUNK)
    # a session's last frame has a part even if it has no length
    cut = rows.where("len > 0 or closing").select(*key, "started_ms", (F.col("ms") - F.col("started_ms")).alias("duration_ms"), "closing", "off", "len", "score", F.explode(F.sequence(first, F.greatest(first, last))).alias("k"))
    shared = F.least(F.col("off") + F.col("len"), (F.col("k") + 1) * CHUNK) - F.greatest("off", F.col("k") * CHUNK)
    heard = W.partitionBy(*key, "k").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    chunks = cut.withColumn("n", shared).select(*key, "started_ms", "duration_ms", "closing", "k", F.sum("n").over(heard).alias("n"), (F.sum(F.col("n") * F.col("score")).over(heard) / CHUNK).alias("score"))
    # the part that fills a chunk has its score; of a session's last frame all other parts than the last fill theirs
    chunks = chunks.where((F.col("n") == CHUNK) | F.col("closing")).withColumn("score", F.when(F.col("n") == CHUNK, F.col("score")))
    order = W.partitionBy(*key).orderBy("k")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    means = chunks.withColumns({"m": F.when(F.col("score").isNotNull(), F.avg("score").over(order.rowsBetween(1 - WINDOW, 0))), "chunks": F.count("score").over(whole), "ends": F.lead("k").over(order).isNull()})
    scored = means.withColumns({"flagged": F.max("m").over(whole) >= THRESHOLD, "final_score": F.sum((1 - DECAY) * F.pow(F.lit(DECAY), F.col("chunks") - 1 - F.col("k")) * F.col("m")).over(whole)}).where("ends")
    return scored.select("call_id", "started_ms", "duration_ms", "chunks", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("final_score", F.lit(0.0)).alias("final_score"))
