"""A prediction log, from the events table.

The mapping is a stand-in that gives the log's columns deterministic values; it
is not a prediction, and l1 to l3 are not model outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.functions.decisions import label_zone


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.least(F.col("value") / 500, F.lit(1.0))
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", p.alias("p"),
        (F.col("event_id") % 12000).alias("input_length"),
        ((F.col("event_id") % 97) / 97).alias("l1_score"), ((F.col("event_id") % 89) / 89).alias("l2_score"),
        F.when(F.col("event_type") != "error", (F.col("event_id") % 83) / 83).alias("l3_score"),
        label_zone(p, "detector").alias("final_label"),
    )


#: The same in SQL, as a common table expression.
SQL = """predictions AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, least(value / 500, 1.0) AS p,
         event_id % 12000 AS input_length, (event_id % 97) / 97.0::DOUBLE AS l1_score, (event_id % 89) / 89.0::DOUBLE AS l2_score,
         CASE WHEN event_type <> 'error' THEN (event_id % 83) / 83.0::DOUBLE END AS l3_score,
         CASE WHEN least(value / 500, 1.0) >= 0.7 THEN 'AI' WHEN least(value / 500, 1.0) <= 0.3 THEN 'HUMAN' ELSE 'UNCERTAIN' END AS final_label
  FROM events)"""
