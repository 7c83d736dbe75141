"""Corpus preparation queries; quality stands for the class label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions import texts as t
from contentlens.operators import corpus as c
from contentlens.plans.base import query, r6, table
from contentlens.plans.text import WORDS

LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.source, d.n_chars, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")



@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY md5(text)")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-01: the first document of each exact text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return c.keep_first(d, F.col("text_md5"), "doc_id")


@query(f"""WITH {LABELLED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('b' || doc_id)) AS rn FROM labelled)
SELECT doc_id, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))""")
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02: shuffle, rank and cut to the rarest class."""
    return c.balance(labelled(spark, sf_dir).select("doc_id", "label"), "label", c.hash_order(F.col("doc_id"), "b"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('s' || doc_id)) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def global_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03: exact 80/10/10 by a seeded order."""
    return c.split_by_rank(table(spark, sf_dir, "documents").select("doc_id"), c.hash_order(F.col("doc_id"), "s"))


@query(f"""WITH {LABELLED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('t' || doc_id)) AS r, count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT doc_id, label, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' WHEN r <= round_even(n * 0.8, 0) + 2 * round_even(n * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-04: the same share of each class."""
    return c.split_stratified(labelled(spark, sf_dir).select("doc_id", "label"), "label", c.hash_order(F.col("doc_id"), "t"))


_SPLIT = """s AS (SELECT doc_id, text, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('s' || doc_id)) AS r, count(*) OVER () AS n FROM documents))"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.split_by_rank(table(spark, sf_dir, "documents").select("doc_id", "text"), c.hash_order(F.col("doc_id"), "s"))


@query(f"""WITH {_SPLIT} SELECT doc_id, split FROM s WHERE split = 'train' OR (split = 'val' AND text NOT IN (SELECT text FROM s WHERE split = 'train'))
  OR (split = 'test' AND text NOT IN (SELECT text FROM s WHERE split IN ('train', 'val')))""")
def leak_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06 U-03: no text in two splits."""
    return c.drop_leaks(_split(spark, sf_dir)).select("doc_id", "split")


@query(f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM (SELECT text FROM s WHERE split = 'train' INTERSECT SELECT text FROM s WHERE split = 'val')) AS train_val,
  (SELECT count(*) FROM (SELECT text FROM s WHERE split = 'train' INTERSECT SELECT text FROM s WHERE split = 'test')) AS train_test,
  (SELECT count(*) FROM (SELECT text FROM s WHERE split = 'val' EXCEPT SELECT text FROM s WHERE split = 'train')) AS val_only""")
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-02 U-03: sizes of intersections and differences."""
    s = _split(spark, sf_dir).withColumn("h", F.md5(F.col("text").cast("binary")))
    g = s.groupBy("h").agg(*[F.max((F.col("split") == k).cast("int")).alias(k) for k in ("train", "val", "test")])
    return g.agg(F.count_if(F.expr("train + val = 2")).alias("train_val"), F.count_if(F.expr("train + test = 2")).alias("train_test"), F.count_if(F.expr("val = 1 and train = 0")).alias("val_only"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('c' || doc_id)) AS rn FROM documents WHERE n_chars BETWEEN 200 AND 8000)
SELECT doc_id, source FROM r WHERE rn <= (SELECT count(*) FROM documents) // (SELECT count(DISTINCT source) FROM documents) // 2""")
def source_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05 S-06: total // sources // 2 rows of each source, within a length range; the cap is the feature."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    each = d.agg(F.floor(F.floor(F.count(F.lit(1)) / F.greatest(F.count_distinct("source"), F.lit(1))) / 2).alias("most"))  # one row
    some = d.where("n_chars between 200 and 8000").crossJoin(F.broadcast(each))
    return c.cap_each(some, "source", F.col("most"), c.hash_order(F.col("doc_id"), "c")).select("doc_id", "source")


@query(f"""WITH {LABELLED}, w AS (SELECT doc_id, label, 1.0::DOUBLE AS weight FROM labelled), hard AS (SELECT doc_id FROM w WHERE label = 0)
SELECT doc_id, label, weight FROM w WHERE doc_id NOT IN (SELECT doc_id FROM hard) UNION ALL SELECT doc_id, label, greatest(weight, 3.0) FROM w, range(3) WHERE doc_id IN (SELECT doc_id FROM hard)""")
def hard_oversampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07 U-04: hard rows three times, with weight 3."""
    w = labelled(spark, sf_dir).select("doc_id", "label", F.lit(1.0).alias("weight"))
    return c.oversample(w, w.where("label = 0"), "doc_id", 3)


_DRAW = "('0x' || substr(md5('{}' || doc_id), 1, 8))::UBIGINT::BIGINT"


@query(f"""WITH d AS (SELECT doc_id, text, length(text) AS n, 512 + {_DRAW.format('len')} % 513 AS target FROM documents),
s AS (SELECT *, {_DRAW.format('start')} % greatest(n - target + 1, 1) AS s0 FROM d),
a AS (SELECT *, instr(substr(text, s0 + 1, 100), '. ') AS pos FROM s), b AS (SELECT *, substr(text, CASE WHEN s0 > 0 AND pos > 0 THEN s0 + pos + 1 ELSE s0 END + 1, target) AS piece FROM a),
e AS (SELECT *, CASE WHEN contains(piece, '.') THEN length(piece) - instr(reverse(piece), '.') ELSE -1 END AS dot FROM b)
SELECT doc_id, md5(CASE WHEN n <= 1024 THEN text WHEN dot > 409.6 THEN substr(piece, 1, dot + 1) ELSE piece END) AS crop_md5 FROM e WHERE n >= 512""")
def cropped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-04: seeded crops at sentence ends; short texts go."""
    d = table(spark, sf_dir, "documents").select("doc_id", c.crop(F.col("text"), F.col("doc_id")).alias("x")).where("x is not null")
    return d.select("doc_id", F.md5(F.col("x").cast("binary")).alias("crop_md5"))


_HALF = "length({0}) // 2 + CASE WHEN instr(substr({0}, length({0}) // 2 + 1, 200), '. ') > 0 THEN instr(substr({0}, length({0}) // 2 + 1, 200), '. ') + 1 ELSE 0 END"


@query(f"""WITH {LABELLED}, a AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('p' || doc_id)) AS rn FROM labelled WHERE label = 0), b AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('p' || doc_id)) AS rn FROM labelled WHERE label = 1)
SELECT a.doc_id AS a, b.doc_id AS b, md5(substr(a.text, 1, {_HALF.format('a.text')}) || ' ' || substr(b.text, {_HALF.format('b.text')} + 1)) AS mix_md5 FROM a JOIN b USING (rn)""")
def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08 T-46: pairs of unlike rows by rank, and the text they make."""
    rows = c.ranked(labelled(spark, sf_dir).select("doc_id", "text", "label"), c.hash_order(F.col("doc_id"), "p"), ["label"])
    a, b = rows.where("label = 0").alias("a"), rows.where("label = 1").alias("b")
    mix = c.mixed(F.col("a.text"), F.col("b.text"))
    return a.join(b, F.col("a.rank") == F.col("b.rank")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.md5(mix.cast("binary")).alias("mix_md5"))


@query(rf"""WITH {LABELLED}, w AS (SELECT label, len({WORDS}) AS n FROM labelled), g AS (SELECT label, avg(n) AS mean, quantile_cont(n, 0.5) AS median, stddev_samp(n) AS std FROM w GROUP BY label)
SELECT label, round(mean, 6) AS mean, median, round(std, 6) AS std, round(100 * (max(mean) OVER () - min(mean) OVER ()) / max(mean) OVER (), 6) AS diff_pct, (100 * (max(mean) OVER () - min(mean) OVER ()) / max(mean) OVER () < 5) AS aligned FROM g""")
def length_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27: lengths by class; the sample deviation."""
    w = labelled(spark, sf_dir).select("label", F.size(t.split_words(F.col("text"))).alias("n"))
    g = w.groupBy("label").agg(F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.stddev_samp("n").alias("std"))
    ends = g.agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"))  # one row for a handful of classes
    diff = 100 * (F.col("hi") - F.col("lo")) / F.col("hi")
    return g.crossJoin(F.broadcast(ends)).select("label", r6(F.col("mean")).alias("mean"), "median", r6(F.col("std")).alias("std"), r6(diff).alias("diff_pct"), (diff < 5).alias("aligned"))


@query(f"""WITH {LABELLED}, k AS (SELECT *, CASE WHEN n_chars < 500 THEN 'adversarial' WHEN n_chars < 2000 THEN 'hard_negative' ELSE 'standard' END AS sample_type FROM labelled)
SELECT label, sample_type, CASE sample_type WHEN 'adversarial' THEN 3.0 WHEN 'hard_negative' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS pct FROM k GROUP BY 1, 2""")
def sample_type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28 J-09: kinds of sample, their weights and shares."""
    kind = F.when(F.col("n_chars") < 500, "adversarial").when(F.col("n_chars") < 2000, "hard_negative").otherwise("standard")
    weights = F.create_map(*[F.lit(x) for kv in (("standard", 1.0), ("adversarial", 3.0), ("hard_negative", 2.0)) for x in kv])
    g = labelled(spark, sf_dir).groupBy("label", kind.alias("sample_type")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("weight", F.element_at(weights, F.col("sample_type"))).withColumn("pct", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy("label"))))


@query(f"""WITH {_SPLIT}, g AS (SELECT split, count(*) AS total, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY split) SELECT split, '{{"split":"' || split || '","total":' || total || ',"chars":' || chars || '}}' AS card FROM g""")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08 S-07: totals of each split as JSON."""
    g = _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.sum(F.length("text")).alias("chars"))
    return g.select("split", F.to_json(F.struct("split", "total", "chars")).alias("card"))


@query("WITH u AS (SELECT doc_id AS id, text, 'documents' AS origin, n_chars, NULL::VARCHAR AS role FROM documents UNION ALL SELECT item_id, text, 'benchmark', NULL, NULL FROM benchmark UNION ALL SELECT conv_id, text, 'conversations', NULL, role FROM conversations) SELECT origin, role, count(*) AS n, count(n_chars) AS with_chars, count(DISTINCT md5(text)) AS texts FROM u GROUP BY 1, 2")
def ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-01: sources of different columns in one table, nulls where one lacks a column."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars", F.lit("documents").alias("origin"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", "role", F.lit("conversations").alias("origin"))
    u = d.unionByName(b, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)
    return u.groupBy("origin", "role").agg(F.count(F.lit(1)).alias("n"), F.count("n_chars").alias("with_chars"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('n' || doc_id)) - 1 AS i FROM documents) SELECT i // 20 AS batch, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY 1""")
def item_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: batches of twenty."""
    r = c.ranked(table(spark, sf_dir, "documents").select("doc_id"), c.hash_order(F.col("doc_id"), "n"))
    return r.groupBy(F.floor((F.col("rank") - 1) / 20).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 512 GROUP BY text), l AS (SELECT d.doc_id, l.quality AS label FROM d JOIN labels l USING (doc_id)),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('b' || doc_id)) AS rn FROM l), b AS (SELECT doc_id, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY label))),
k AS (SELECT doc_id, label, row_number() OVER (ORDER BY md5('s' || doc_id)) AS r, count(*) OVER () AS n FROM b)
SELECT doc_id, label, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM k""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus build end to end: drop short texts, dedup, balance, split."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") >= 512)
    first = d.groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = first.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return c.split_by_rank(c.balance(rows, "label", c.hash_order(F.col("doc_id"), "b")), c.hash_order(F.col("doc_id"), "s"))
