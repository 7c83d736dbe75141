"""Tables of a relational database by JDBC.

A read is split over tasks by ranges of a whole-number column; its bounds come
from the database's own min and max.  Filters and columns go to the database
(EXPLAIN shows PushedFilters), so a job's scan reads what the query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Conf that names the database for the registered queries.
URL = "spark.contentlens.jdbc.url"
_EMBEDDED = "jdbc:derby:memory:contentlens;create=true"


def url_of(spark: SparkSession) -> str:
    """The database in the session's conf; a local session has an embedded one in memory, which executors elsewhere could not reach."""
    if url := spark.conf.get(URL, None):
        return url
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {URL} to a database that all executors reach")
    return _EMBEDDED


def _options(url: str, options: dict[str, str]) -> dict[str, str]:
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"} if url.startswith("jdbc:derby:") else {}
    return {"url": url} | own | options


def read_table(spark: SparkSession, url: str, table: str, split_by: str | None = None, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A table, in ``parts`` ranges of the column ``split_by``; rows where that is null are in the first range."""
    options = _options(url, options)
    read = spark.read.format("jdbc").options(**options)
    if not split_by or parts < 2:
        return read.option("dbtable", table).load()
    column = f"{quote}{split_by}{quote}"
    lo, hi = read.option("dbtable", f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) bounds").load().first()
    if lo is None or lo == hi:
        return spark.read.format("jdbc").options(**options).option("dbtable", table).load()
    ranges = {"partitionColumn": split_by, "lowerBound": str(int(lo)), "upperBound": str(int(hi) + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options, **ranges).option("dbtable", table).load()


def write_table(df: DataFrame, url: str, table: str, types: str | None = None, mode: str = "overwrite", batch: int = 5000, **options: str) -> None:
    """Rows in batches of inserts; types gives columns the database's own types ("status VARCHAR(16)")."""
    write = df.write.format("jdbc").options(**_options(url, options)).option("dbtable", table).option("batchsize", batch)
    (write.option("createTableColumnTypes", types) if types else write).mode(mode).save()
