"""Structured Streaming: the prediction log, windows with watermarks, sessions with state, batch progress.

Late rows are dropped beyond a watermark, and days close by event time.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from contentlens.sources import versioned


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream; files_per_trigger bounds a batch."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(folder)


def log_sink(stream: DataFrame, folder: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Appends to files by day; the sink's own log makes each batch count once."""
    dated = stream.withColumn("date", F.to_date(ts))
    return dated.writeStream.format("parquet").partitionBy("date").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_counts(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return w.groupBy(F.window("__ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.to_date("window.start").alias("day"), "n", "mean")


def failure_rates(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Share of errors in the last five minutes, every minute."""
    w = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = w.groupBy(F.window("__ts", "5 minutes", "1 minute")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return g.select(F.col("window.end").alias("at"), "n", "failed", (F.col("failed") / F.col("n")).alias("rate"))


def user_sessions(stream: DataFrame, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = w.groupBy(F.session_window("__ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


def alert_kind(scores: list[float]) -> str:
    """voice_clone: the last scores are high and even; impersonation: they range widely; else ai_voice (fixed values)."""
    if scores and statistics.pstdev(scores) < 0.05 and statistics.fmean(scores) > 0.8:
        return "voice_clone"
    return "impersonation" if scores and max(scores) - min(scores) > 0.4 else "ai_voice"


def rolling_alerts(stream: DataFrame, threshold: float = 0.75, window: int = 4, gap_ms: int = 5000, decay: float = 0.85) -> DataFrame:
    """Per call: mean of the last scores, weighted average, and an alert at most once in gap_ms, with its kind.

    Input: call_id, ms, score, ts (event time).  State: the last scores, the average and the time of the last alert; a call's rows
    are taken in order within a batch, and state goes after an hour of event time without rows.
    """
    out = "call_id long, ms long, rolling double, ewma double, alert boolean, kind string"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scores, mean, last = state.get if state.exists else ([], 0.0, None)
        scores = list(scores)
        rows = pd.concat(list(parts)).sort_values(["ms", "score"])
        found = []
        for ms, score in zip(rows["ms"].tolist(), rows["score"].tolist()):
            scores = [*scores, score][-window:]
            rolling, mean = sum(scores) / len(scores), decay * mean + (1 - decay) * score
            alert = rolling >= threshold and (last is None or ms - last >= gap_ms)
            last = ms if alert else last
            found.append((key[0], ms, rolling, mean, alert, alert_kind(scores) if alert else None))
        state.update((scores, mean, last))
        state.setTimeoutTimestamp(max(rows["ts"].max().value // 1_000_000, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(found, columns=["call_id", "ms", "rolling", "ewma", "alert", "kind"])

    marked = stream.withWatermark("ts", "1 hour")
    return marked.groupBy("call_id").applyInPandasWithState(step, out, "scores array<double>, mean double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(stream: DataFrame, folder: str, checkpoint: str, key: str) -> StreamingQuery:
    """Latest row of each key in a versioned table: a batch replaces the rows of its keys, a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        versioned.merge(batch.sparkSession, folder, versioned.upsert(key, batch), number)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
