"""A table that changes by whole versions, each committed by compare and set.

A version is a folder of parquet and a small file ``_versions/<number>`` that
names it.  That file is created only where it is not there yet (atomic in HDFS-like
stores), so of two writers that start from one version one wins; the other reads the
table again and repeats its change.  A change that carries a batch number is done
once: its number is kept with the version, so a replayed batch finds it and leaves the table alone.
Readers see a version or the next, never a half; the version before the last stays for those still reading it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers won in every attempt."""


def _fs(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _entries(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The versions that are named, by number: two as a rule."""
    fs, path = _fs(spark, f"{folder}/_versions")
    if not fs.exists(path):
        return {}
    out = {}
    for status in fs.listStatus(path):
        if status.getPath().getName().isdigit():
            stream = fs.open(status.getPath())
            try:
                out[int(status.getPath().getName())] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return out


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last version, or None."""
    entries = _entries(spark, folder)
    return spark.read.parquet(f"{folder}/{entries[max(entries)]['data']}") if entries else None


def done(spark: SparkSession, folder: str, batch: int) -> bool:
    """Whether the batch of this number, or a later one, is in the table."""
    return any(e["batch"] is not None and e["batch"] >= batch for e in _entries(spark, folder).values())


def _commit(spark: SparkSession, folder: str, number: int, data: str, batch: int | None) -> bool:
    fs, path = _fs(spark, f"{folder}/_versions/{number:020d}")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    stream.write(json.dumps({"data": data, "batch": batch}).encode())
    stream.close()
    return True


def merge(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], batch: int | None = None, attempts: int = 3) -> int | None:
    """Commits change(the table) as the next version and gives its number; None if the batch has been done."""
    for _ in range(attempts):
        if batch is not None and done(spark, folder, batch):
            return None
        entries = _entries(spark, folder)
        last, data = max(entries, default=0), f"data-{uuid.uuid4().hex}"
        current = spark.read.parquet(f"{folder}/{entries[last]['data']}") if entries else None
        change(current).write.parquet(f"{folder}/{data}")
        latest = batch if batch is not None else max((e["batch"] for e in entries.values() if e["batch"] is not None), default=None)
        if _commit(spark, folder, last + 1, data, latest):
            for number in sorted(entries)[:-1]:
                for old in (f"{folder}/_versions/{number:020d}", f"{folder}/{entries[number]['data']}"):
                    fs, path = _fs(spark, old)
                    fs.delete(path, True)
            return last + 1
        fs, path = _fs(spark, f"{folder}/{data}")
        fs.delete(path, True)
    raise Conflict(f"{folder}: {attempts} attempts lost to other writers")


def upsert(key: str, rows: DataFrame) -> Callable[[DataFrame | None], DataFrame]:
    """A change for merge(): rows replace those of their key; of several rows of a key one stays, the same one in every run."""
    value = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*value), F.xxhash64(*value)).alias("v")).select(key, "v.*")
    return lambda table: one if table is None else table.join(one.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti").unionByName(one)
