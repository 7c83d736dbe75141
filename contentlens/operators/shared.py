"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local session takes a temporary one and a cluster gets an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='contentlens-')}")
    return _own[0]


#: Spark's own switch: what a job has shuffled goes when the job ends, not when the driver's JVM happens to collect its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _saved(df: DataFrame, by: str | None = None) -> str:
    """The folder to which df is written; what the write shuffles goes with its end, the files when the application ends or with ``dropped``."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/contentlens-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(where)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def written(df: DataFrame) -> DataFrame:
    """df written once and read back: lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(_saved(df))


def written_slices(df: DataFrame, number: Column, many: int) -> list[DataFrame]:
    """df written once and read back as ``many`` tables, by a number from 0, each of which can be ``dropped`` by itself."""
    if many == 1:
        return [written(df)]
    spark, where = df.sparkSession, _saved(df.withColumn("__slice", number), "__slice")
    fs = spark._jvm.org.apache.hadoop.fs.Path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f"{where}/__slice={i}" for i in range(many)]
    return [spark.read.schema(df.schema).parquet(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) else spark.createDataFrame([], df.schema) for p in paths]


def dropped(*tables: DataFrame) -> None:
    """Takes away the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
