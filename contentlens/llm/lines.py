"""Line dedup by distinct-site spread (DataFrame functions only).

Every line is hashed; a HyperLogLog sketch of the sites that show it is built
per hash and merged by aggregation.  Lines whose estimate is well above the
threshold are boilerplate, those well below are kept, and those near it get an
exact distinct count.  A boilerplate line stays at its first place (smallest
doc_id, then position) and goes everywhere else, so no passage leaves the
corpus altogether.

Defined cases: blank lines never count as boilerplate and always stay; a null
text stays null and an empty one empty; a null site is a site of its own; rows
with a null id neither count nor change; a repeated row is the same document,
and each of its copies keeps the line; rows that share an id but not a text are
told apart by a hash of the text; extra columns pass through, whatever their
names (an input column n_removed is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import free, materialise

#: lgConfigK of the sketch, and its relative error (one standard deviation, rounded up).
LG_K, ERROR = 10, 0.04
#: Parts in which the rows of one line are gathered first.
SALTS = 64


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _shown(documents: DataFrame, site: str) -> DataFrame:
    """A row for each non-blank line: hash of the line, site, and its place (document, text, number)."""
    rows = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(_lines()).alias("place", "line")
    )
    return rows.where(F.trim("line") != "").select(F.xxhash64("line").alias("h"), "site", F.struct("doc_id", "t", "place").alias("at"))


def boilerplate(documents: DataFrame, min_sites: int = 5, site: str = "source") -> DataFrame:
    """Lines seen on at least ``min_sites`` distinct sites: h (line hash), sites, first (where it stays)."""
    shown = _shown(documents, site)
    # a line on min_sites sites shows up at least that often: only such lines get a sketch
    # written, so that the join is not tied to the partitions of this count and AQE can split a frequent line's
    often = materialise(shown.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h"))
    rows = shown.join(often, "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("at.doc_id"), F.lit(SALTS)))
    # in two steps, the first by salt: a line that very many rows show is sketched by many tasks
    parts = rows.groupBy("h", "salt").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("at").alias("first"))
    sketched = (
        parts.groupBy("h")
        .agg(F.hll_union_agg("sketch").alias("sketch"), F.min("first").alias("first"))
        .select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    sketched = materialise(sketched)  # one row for each repeated line; read twice below
    margin = max(1.0, 5 * ERROR * min_sites)
    sure = sketched.where(F.col("sites") > min_sites + margin)
    near = sketched.where(F.col("sites").between(min_sites - margin, min_sites + margin))
    exact = (
        shown.join(near.select("h"), "h", "left_semi")
        .groupBy("h", "site").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sure.select("h", "sites", "first").unionByName(near.drop("sites").join(exact, "h").select("h", "sites", "first"))


def dedup_lines(documents: DataFrame, min_sites: int = 5, site: str = "source", removed: str = "n_removed") -> DataFrame:
    """Documents without repeats of boilerplate lines; text and n_chars (where there is one) change, the number of lines removed is added."""
    bad = boilerplate(documents, min_sites, site).select("h", "first")
    # by hash: a frequent line is a large key on the left, which AQE splits
    hits = _shown(documents, site).join(bad, "h").where("at <> first")
    gone, of, t = (free(documents, f"__{n}") for n in ("gone", "id", "t"))
    keys = hits.groupBy("at.doc_id", "at.t").agg(F.collect_set("at.place").alias(gone)).select(F.col("doc_id").alias(of), F.col("t").alias(t), gone)
    names = [c for c in documents.columns if c != removed]
    joined = documents.join(keys, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(t)), "left")
    kept = F.array_join(F.filter(_lines(), lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names], F.coalesce(F.size(gone), F.lit(0)).alias(removed))
