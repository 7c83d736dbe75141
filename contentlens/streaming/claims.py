"""Workers' claims on jobs, by version.

A claim names a job and the version that its worker has seen.  In order of time,
a claim on a pending job takes it (version + 1, processing, started now), after
one more attempt if the version is another; a claim on a job that has been
processing for ``stale`` or longer takes it over; one on a job with a live owner or at its end
finds it handled.  So the claims that win are those at least ``stale`` apart,
which ``spaced`` finds for all jobs at once, however many claims one job has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentlens.operators.shared import written
from contentlens.operators.spacing import spaced
from contentlens.sources import versioned

STALE = 600_000_000  # ten minutes, in microseconds
ATTEMPTS = 3


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def outcomes(jobs: DataFrame, claims: DataFrame, stale: int = STALE) -> DataFrame:
    """claim_id, job_id, at, outcome (claimed, reclaimed, handled, missing), version (after it, where it won), attempts.

    jobs: job_id (unique), status, version, started_at.  claims: claim_id (unique), job_id, at, seen.  Of claims at
    one time the smallest id wins.  Claims without a time, or with a null job_id, are missing.
    """
    j = jobs.select("job_id", "status", "version", _micros("started_at").alias("since"), F.lit(True).alias("known"))
    rows = written(claims.select("claim_id", "job_id", "at", "seen", _micros("at").alias("t")).join(j, "job_id", "left"))
    pending = F.col("status") == "PENDING"
    free = pending | ((F.col("status") == "PROCESSING") & F.coalesce(F.col("t") >= F.col("since") + stale, F.lit(True)))
    wins = spaced(rows.where("known").where(free), "job_id", "t", stale).select("k.job_id", "t")
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("t"))
    wins = wins.withColumn("n", rank)
    first = rows.groupBy("job_id", "t").agg(F.min("claim_id").alias("claim_id"))  # of claims at one time
    wins = wins.join(first, ["job_id", "t"]).select("claim_id", "n")
    out = rows.join(wins, "claim_id", "left")
    won = F.col("n").isNotNull()
    outcome = (
        F.when(F.col("known").isNull() | F.col("t").isNull(), "missing").when(won & pending & (F.col("n") == 1), "claimed").when(won, "reclaimed").otherwise("handled")
    )
    again = won & pending & (F.col("n") == 1) & ~F.col("seen").eqNullSafe(F.col("version"))
    return out.select("claim_id", "job_id", "at", outcome.alias("outcome"), (F.col("version") + F.col("n")).alias("version"), F.when(again, 2).otherwise(1).alias("attempts"))


def applied(jobs: DataFrame, result: DataFrame) -> DataFrame:
    """The jobs after the outcomes of a batch."""
    won = result.where("version is not null").groupBy("job_id").agg(F.max("version").alias("__v"), F.max("at").alias("__at"))
    hit = F.col("__v").isNotNull()
    new = {"status": F.when(hit, "PROCESSING").otherwise(F.col("status")), "version": F.coalesce("__v", "version"), "started_at": F.coalesce("__at", "started_at")}
    return jobs.join(won, "job_id", "left").withColumns(new).select(*jobs.columns)


def claim_sink(stream: DataFrame, jobs: str, results: str, checkpoint: str, stale: int = STALE) -> StreamingQuery:
    """Merges each batch of claims into the versioned table ``jobs`` and writes its outcomes to ``results/batch=<number>``.

    A replayed batch finds its number in the table and changes nothing.  Where another writer commits first, the
    claims are judged again on what it left, at most ATTEMPTS times.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        claims = written(batch)

        def change(table: DataFrame | None) -> DataFrame:
            if table is None:
                raise RuntimeError(f"{jobs} has no version yet")
            result = written(outcomes(table, claims, stale))
            result.write.mode("overwrite").parquet(f"{results}/batch={number}")
            return applied(table, result)

        versioned.merge(spark, jobs, change, number, ATTEMPTS)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
