"""Reading and writing corpora and logs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("model_version", T.StringType()), T.StructField("input_length", T.LongType()), T.StructField("l1_score", T.DoubleType()), T.StructField("l2_score", T.DoubleType()),
    T.StructField("l3_score", T.DoubleType()), T.StructField("meta_probability", T.DoubleType()), T.StructField("final_label", T.StringType()), T.StructField("confidence_margin", T.DoubleType()), T.StructField("zone", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = LOG) -> DataFrame:
    """One record a line; blank and malformed lines are skipped, a missing path has no rows."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_days(spark: SparkSession, folder: str, lo: str, hi: str, schema: T.StructType = LOG) -> DataFrame:
    """Day files YYYY-MM-DD.jsonl from lo to hi; sample files (*.samples.jsonl) are not read."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "????-??-??.jsonl").json(folder)
    day = F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
    return rows.withColumn("day", day).where(F.col("day").between(lo, hi))


def read_parquet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Fails before any job if a required column is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks columns {missing}; it has {df.columns}")
    return df


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def upsert_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replaces the days in df and leaves the others; the committer makes each write all or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def provenance(df: DataFrame, **facts: str) -> DataFrame:
    """One row: count, a hash of all rows that does not depend on their order, the schema, and given facts."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    summed = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content"))
    return summed.withColumn("schema", F.lit(json.dumps(df.schema.jsonValue(), sort_keys=True))).withColumns({k: F.lit(v) for k, v in facts.items()})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_with_facts(df: DataFrame, path: str, facts: dict[str, str], columns: dict[str, dict[str, str]] | None = None, mode: str = "error") -> None:
    """Parquet whose footers carry facts of the table (a commit, a clock, counts: given by the caller) and of its columns.

    Facts of the table are kept with the first column, under ``table``; Spark stores both with its schema in every file.
    """
    columns = columns or {}
    if unknown := set(columns) - set(df.columns):
        raise ValueError(f"no columns {sorted(unknown)}; there are {df.columns}")
    first = df.columns[0]
    meta = {c: {"facts": columns.get(c, {})} | ({"table": facts} if c == first else {}) for c in df.columns}
    df.select(*[F.col(f"`{c}`").alias(c, metadata=m) if any(m.values()) else F.col(f"`{c}`") for c, m in meta.items()]).write.mode(mode).parquet(path)


def read_facts(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The facts of a table and of its columns, from the footers alone; empty where there are none."""
    fields = spark.read.parquet(path).schema.fields
    table = next((f.metadata["table"] for f in fields if "table" in f.metadata), {})
    return table, {f.name: f.metadata["facts"] for f in fields if f.metadata.get("facts")}
