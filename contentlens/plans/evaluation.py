"""Evaluation queries: deterministic stand-in scores against the quality label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions.decisions import clip, label_zone, metadata_adjusted
from contentlens.functions.texts import tokens
from contentlens.functions.vectors import detector_vector, layer_vector
from contentlens.operators import evaluation as e
from contentlens.operators import isotonic
from contentlens.plans.base import query, r6, table

#: A number from 0 to 1 drawn from md5; l1 to l3 lean towards the label.  Stand-ins, not model outputs.
_U = "(('0x' || substr(md5('{}' || d.doc_id), 1, 6))::UBIGINT / 16777215)"
SCORED = f"""scored AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality AS y, l.toxic,
  round({_U.format('a')} * 0.6 + l.quality * 0.4, 4) AS l1, round({_U.format('b')} * 0.7 + l.quality * 0.3, 4) AS l2, round({_U.format('c')} * 0.8 + l.quality * 0.2, 4) AS l3
  FROM documents d JOIN labels l USING (doc_id)), fused AS (SELECT *, round(0.2 * l1 + 0.35 * l2 + 0.45 * l3, 6) AS s FROM scored)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic")  # noqa: E741
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(k), F.col("doc_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") / 16777215
    lean = lambda k, a: F.round(u(k) * a + F.col("y") * (1 - a), 4)
    out = d.join(l, "doc_id").withColumns({"l1": lean("a", 0.6), "l2": F.round(u("b") * 0.7 + F.col("y") * 0.3, 4), "l3": F.round(u("c") * 0.8 + F.col("y") * 0.2, 4)})
    return out.withColumn("s", F.round(0.2 * F.col("l1") + 0.35 * F.col("l2") + 0.45 * F.col("l3"), 6))


_PRF = "round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) AS accuracy"
_CM = "count(*) FILTER (WHERE {0} AND y = 1) AS tp, count(*) FILTER (WHERE {0} AND y = 0) AS fp, count(*) FILTER (WHERE NOT {0} AND y = 1) AS fn, count(*) FILTER (WHERE NOT {0} AND y = 0) AS tn"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query(f"WITH {SCORED}, g AS (SELECT lang, {_CM.format('(s > 0.41)')} FROM fused GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_PRF} FROM g")
def confusion_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15 D-05: confusion matrix and its rates."""
    return _rounded(e.confusion(scored(spark, sf_dir), ["lang"], F.col("s") > 0.41, "y"), "precision", "recall", "f1", "accuracy")


@query(f"""WITH {SCORED}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS r FROM fused),
g AS (SELECT source, sum(r) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM r GROUP BY source)
SELECT source, round((rs - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auroc FROM g""")
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16: rank-sum area, null for one class."""
    return _rounded(e.auroc(scored(spark, sf_dir), ["source"], "s", "y"), "auroc")


_W = "{k} / nullif({n}, 0)"
_WILSON = "round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))), 6) AS low, round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))), 6) AS high"


@query(f"WITH {SCORED}, g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE (s > 0.41) = (y = 1)) AS k FROM fused GROUP BY source), p AS (SELECT *, k / n AS p FROM g) SELECT source, n, k, {_WILSON} FROM p")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: 95% interval of accuracy."""
    g = scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("s") > 0.41) == (F.col("y") == 1)).alias("k"))
    low, high = e.wilson(F.col("k"), F.col("n"))
    return g.withColumn("low", r6(low)).withColumn("high", r6(high))


_ZONE = "CASE WHEN s >= 0.7 THEN 'AI' WHEN s <= 0.3 THEN 'HUMAN' ELSE 'UNCERTAIN' END"


@query(f"""WITH {SCORED}, z AS (SELECT *, {_ZONE} AS zone FROM fused), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE zone <> 'UNCERTAIN') AS sure,
  count(*) FILTER (WHERE zone <> 'UNCERTAIN' AND (zone = 'AI') = (y = 1)) AS right_, count(*) FILTER (WHERE zone = 'AI' AND y = 1) AS tp, count(*) FILTER (WHERE zone = 'AI' AND y = 0) AS fp, count(*) FILTER (WHERE zone <> 'AI' AND y = 1) AS fn FROM z)
SELECT n, sure, round(sure / n, 6) AS coverage, round(1 - sure / n, 6) AS abstain, round(right_ / nullif(sure, 0), 6) AS reliability, round(2 * tp / (2 * tp + fp + fn), 6) AS full_f1 FROM g""")
def reliability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18: coverage, and correctness where there is a definite label; UNCERTAIN counts as not AI in the full F1."""
    z = scored(spark, sf_dir).withColumn("zone", label_zone(F.col("s"), "detector"))
    sure, ai, y = F.col("zone") != "UNCERTAIN", F.col("zone") == "AI", F.col("y") == 1
    g = z.agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("sure"), F.count_if(sure & (ai == y)).alias("right"), F.count_if(ai & y).alias("tp"), F.count_if(ai & ~y).alias("fp"), F.count_if(~ai & y).alias("fn"))
    c = F.col("sure") / F.col("n")
    return g.select("n", "sure", r6(c).alias("coverage"), r6(1 - c).alias("abstain"), r6(F.try_divide("right", "sure")).alias("reliability"), r6(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("full_f1"))


@query(f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n, count(DISTINCT y) AS classes, {_CM.format('(s >= 0.7)')} FROM fused GROUP BY source)
SELECT source, n, CASE WHEN classes > 1 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) END AS f1, round((tp + tn) / n, 6) AS accuracy FROM g""")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19 D-06: F1 of a source, null for one class."""
    d = scored(spark, sf_dir)
    g = e.confusion(d, ["source"], F.col("s") >= 0.7, "y").join(d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")), "source")
    return g.select("source", "n", r6(F.when(F.col("classes") > 1, F.col("f1"))).alias("f1"), r6("accuracy").alias("accuracy"))


@query(f"""WITH {SCORED}, t AS (SELECT round(0.3 + i * 0.01, 2) AS threshold FROM range(41) r(i)),
g AS (SELECT threshold, count(*) FILTER (WHERE s > threshold AND y = 1) AS tp, count(*) FILTER (WHERE s > threshold AND y = 0) AS fp, count(*) FILTER (WHERE s <= threshold AND y = 1) AS fn FROM fused, t GROUP BY 1),
f AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM g) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, f1, row_number() OVER (ORDER BY f1 DESC, abs(threshold - 0.5), threshold) = 1 AS best FROM f""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: best F1, ties to the threshold nearest .5."""
    s = e.sweep(scored(spark, sf_dir), "s", "y", [round(0.3 + i * 0.01, 2) for i in range(41)]).withColumn("f1", F.round("f1", 9))
    first = F.row_number().over(W.orderBy(F.desc("f1"), F.abs(F.col("threshold") - 0.5), "threshold"))  # 41 rows
    return s.withColumn("best", first == 1)


@query(f"""WITH {SCORED}, t AS (SELECT round(0.3 + i * 0.02, 2) AS threshold FROM range(26) r(i)),
g AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE s < threshold AND y = 1) AS fn FROM fused, t GROUP BY 1),
f AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM g) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, f1, f1 > 0 AND row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f""")
def first_best_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: thresholds from .30 to .80 by .02, a score at the threshold is positive; the first of the best F1."""
    s = e.sweep(scored(spark, sf_dir), "s", "y", [round(0.3 + i * 0.02, 2) for i in range(26)], at_least=True).withColumn("f1", F.round("f1", 9))
    return s.withColumn("best", (F.col("f1") > 0) & (F.row_number().over(W.orderBy(F.desc("f1"), "threshold")) == 1))  # 26 rows


@query(f"""WITH {SCORED}, t AS (SELECT i / 20 AS skip_t, j / 20 AS flag_t FROM range(1, 9) a(i), range(2, 16) b(j) WHERE j > i),
g AS (SELECT skip_t, flag_t, count(*) FILTER (WHERE l1 < skip_t AND y = 1) / greatest(count(*) FILTER (WHERE y = 1), 1) AS fn_rate, count(*) FILTER (WHERE l1 < flag_t) / count(*) AS skip_rate,
  count(*) FILTER (WHERE l1 >= flag_t AND y = 0) / nullif(count(*) FILTER (WHERE y = 0), 0) AS flagged FROM scored, t GROUP BY 1, 2),
a AS (SELECT *, fn_rate <= 0.02 AND coalesce(flagged <= 1 - 0.15, true) AS allowed FROM g)
SELECT skip_t, flag_t, round(fn_rate, 9) AS fn_rate, round(skip_rate, 9) AS skip_rate, round(flagged, 9) AS flagged, allowed, allowed AND skip_rate > 0 AND row_number() OVER (ORDER BY allowed DESC, skip_rate DESC, skip_t, flag_t) = 1 AS best FROM a""")
def tier_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: pairs of thresholds for two tiers under limits on missed positives and flagged negatives."""
    g = e.tier_grid(scored(spark, sf_dir), "l1", "y")
    return g.withColumns({c: F.round(c, 9) for c in ("fn_rate", "skip_rate", "flagged")})


@query(f"""WITH RECURSIVE {SCORED}, c AS (SELECT s, count(*) AS n, sum(y) AS pos FROM fused GROUP BY s),
x AS (SELECT s, n, pos, ln(greatest(1e-6, least(1 - 1e-6, s))::DOUBLE / (1 - greatest(1e-6, least(1 - 1e-6, s))::DOUBLE)) AS x FROM c),
newton AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT i, a, b, sum((n * p - pos) * x) + a / 1e4 AS ga, sum(n * p - pos) AS gb, sum(n * p * (1 - p) * x * x) + 1 / 1e4 AS haa, sum(n * p * (1 - p) * x) AS hab, sum(n * p * (1 - p)) AS hbb
        FROM (SELECT i, a, b, n, pos, x, 1 / (1 + exp(-(a * x + b))) AS p FROM newton, x WHERE i < 20) GROUP BY i, a, b)),
k AS (SELECT s, n, pos, sum(n) OVER (ORDER BY s) AS cx, sum(pos) OVER (ORDER BY s) AS cy FROM c),
lows AS (SELECT l.cx - l.n AS x0, r.cx AS x1, (r.cy - l.cy + l.pos) / (r.cx - l.cx + l.n) AS m FROM k l JOIN k r ON r.cx >= l.cx),
least_to AS (SELECT x0, k.cx AS cx, min(m) AS m FROM lows JOIN k ON k.cx > x0 AND k.cx <= x1 GROUP BY 1, 2),
iso AS (SELECT k.s, max(l.m) AS isotonic FROM k JOIN least_to l ON l.cx = k.cx GROUP BY k.s),
fit AS (SELECT f.doc_id, 1 / (1 + exp(-(w.a * x.x + w.b))) AS platt, isotonic FROM fused f JOIN x USING (s) JOIN iso USING (s), (SELECT a, b FROM newton WHERE i = 20) w)
SELECT doc_id, round(platt, 6) AS platt, round(isotonic, 6) AS isotonic, round(greatest(0.01, least(0.99, (platt + isotonic) / 2)), 6) AS calibrated FROM fit""")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-23: logistic and isotonic calibration, averaged and clipped; the SQL takes the isotonic fit as a maximum of minima."""
    out = isotonic.calibrated(scored(spark, sf_dir).select("doc_id", "s", "y"), "s", "y")
    return out.select("doc_id", r6("platt").alias("platt"), r6("isotonic").alias("isotonic"), r6("calibrated").alias("calibrated"))


@query(f"""WITH {SCORED}, w AS (SELECT i / 20 AS w1, j / 20 AS w2, (20 - i - j) / 20 AS w3 FROM range(21) a(i), range(21) b(j) WHERE i + j <= 20), t AS (SELECT round(0.4 + k * 0.01, 2)::DOUBLE AS threshold FROM range(41) r(k)),
x AS (SELECT w1, w2, w3, l1 * w1 + l2 * w2 + l3 * w3 AS s, y FROM scored, w),
g AS (SELECT w1, w2, w3, threshold, count(*) FILTER (WHERE s > threshold AND y = 1) AS tp, count(*) FILTER (WHERE s > threshold) AS yes, CAST(sum(y) AS BIGINT) AS p FROM x, t GROUP BY ALL)
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, threshold, round(2 * tp / (yes + p), 6) AS f1 FROM g ORDER BY round(2 * tp / (yes + p), 9) DESC, w3 DESC, w1, threshold LIMIT 10""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21 J-12: 231 weight vectors by the 41 thresholds from .40 to .80; the ten best, ties to the larger w3."""
    g = e.grid_search(scored(spark, sf_dir), ["l1", "l2", "l3"], "y", [round(0.4 + i * 0.01, 2) for i in range(41)])
    top = g.orderBy(F.desc(F.round("f1", 9)), F.desc("w3"), "w1", "threshold").limit(10)
    return top.select(r6("w1").alias("w1"), r6("w2").alias("w2"), r6("w3").alias("w3"), "threshold", r6("f1").alias("f1"))


@query(f"""WITH {SCORED}, x AS (SELECT doc_id, s, y, CASE WHEN s >= 0.5 AND y = 0 THEN 'false_positive' WHEN s < 0.5 AND y = 1 THEN 'false_negative' END AS error_type FROM fused),
r AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'false_positive' THEN -s ELSE s END, doc_id) AS rank FROM x WHERE error_type IS NOT NULL) SELECT doc_id, s, error_type, rank FROM r WHERE rank <= 5""")
def hard_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01: the five worst errors of each kind."""
    kind = F.when((F.col("s") >= 0.5) & (F.col("y") == 0), "false_positive").when((F.col("s") < 0.5) & (F.col("y") == 1), "false_negative")
    x = scored(spark, sf_dir).select("doc_id", "s", kind.alias("error_type")).where("error_type is not null")
    wrong = F.when(F.col("error_type") == "false_positive", -F.col("s")).otherwise(F.col("s"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("error_type").orderBy(wrong, "doc_id"))).where("rank <= 5")


@query(f"""WITH {SCORED}, g AS (SELECT lang, {_CM.format('(s > 0.5)')} FROM fused GROUP BY lang), m AS (SELECT lang, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, fp / greatest(fp + tn, 1) AS fpr FROM g)
SELECT lang, round(f1, 6) AS f1, round(fpr, 6) AS fpr, (f1 >= 0.9) AS f1_ok, (fpr <= 0.1) AS fpr_ok, (f1 >= 0.9 AND fpr <= 0.1) AS passed FROM m""")
def sla_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-34 D-14: floors and ceilings of an accuracy agreement."""
    g = e.confusion(scored(spark, sf_dir), ["lang"], F.col("s") > 0.5, "y")
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return g.select("lang", r6("f1").alias("f1"), r6(fpr).alias("fpr"), (F.col("f1") >= 0.9).alias("f1_ok"), (fpr <= 0.1).alias("fpr_ok"), ((F.col("f1") >= 0.9) & (fpr <= 0.1)).alias("passed"))


@query(f"""WITH {SCORED}, a AS (SELECT attack, strength, s, greatest(0.01, s - strength * k) AS hit FROM fused, (VALUES ('shuffle', 0.1), ('synonym', 0.2), ('homoglyph', 0.3)) x(attack, k), (VALUES (0.5), (1.0)) z(strength) WHERE y = 1)
SELECT attack, strength::DOUBLE AS strength, round(avg(s), 6) AS baseline, round(avg(hit), 6) AS attacked, round(avg(s) - avg(hit), 6) AS drop_, round(avg((hit >= 0.5)::INT), 6) AS detection_rate, (avg((hit >= 0.5)::INT) >= 0.6) AS passed FROM a GROUP BY 1, 2""")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: what attacks of given strength do to scores."""
    attacks = F.explode(F.array(*[F.struct(F.lit(n).alias("attack"), F.lit(k).alias("k")) for n, k in (("shuffle", 0.1), ("synonym", 0.2), ("homoglyph", 0.3))]))
    a = scored(spark, sf_dir).where("y = 1").select("s", attacks.alias("a")).select("s", "a.*", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("strength"))
    a = a.withColumn("hit", F.greatest(F.lit(0.01), F.col("s") - F.col("strength") * F.col("k")))
    rate = F.avg((F.col("hit") >= 0.5).cast("double"))
    return a.groupBy("attack", "strength").agg(r6(F.avg("s")).alias("baseline"), r6(F.avg("hit")).alias("attacked"), r6(F.avg("s") - F.avg("hit")).alias("drop_"), r6(rate).alias("detection_rate"), (rate >= 0.6).alias("passed"))


@query(f"""WITH {SCORED}, g AS (SELECT y, avg(l1) AS m, stddev_pop(l1) AS sd FROM scored GROUP BY y) SELECT round(pow(max(m) - min(m), 2) / sum(sd * sd), 6) AS fisher FROM g""")
def fisher_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-29: separation of two classes."""
    g = scored(spark, sf_dir).groupBy("y").agg(F.avg("l1").alias("m"), F.stddev_pop("l1").alias("sd"))
    return g.agg(r6(F.pow(F.max("m") - F.min("m"), 2) / F.sum(F.col("sd") * F.col("sd"))).alias("fisher"))


@query(f"""WITH {SCORED}, k AS (SELECT *, CASE WHEN n_chars < 500 THEN 'adversarial' WHEN n_chars < 2000 THEN 'hard_negative' ELSE 'standard' END AS kind FROM fused)
SELECT kind, y, count(*) AS n, round(avg((s > 0.41)::INT), 6) AS ai_rate, round(avg((s <= 0.41)::INT), 6) AS human_rate FROM k GROUP BY 1, 2""")
def sample_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-07: rates by kind of sample and class."""
    kind = F.when(F.col("n_chars") < 500, "adversarial").when(F.col("n_chars") < 2000, "hard_negative").otherwise("standard")
    ai = (F.col("s") > 0.41).cast("double")
    return scored(spark, sf_dir).groupBy(kind.alias("kind"), "y").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(ai)).alias("ai_rate"), r6(F.avg(1 - ai)).alias("human_rate"))


@query(f"""WITH {SCORED}, p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE l3 END AS l3, l1, l2, n_chars FROM scored),
f AS (SELECT doc_id, CASE WHEN l3 IS NULL THEN 2 ELSE 3 END AS layers, greatest(0.01, least(0.99, CASE WHEN l3 IS NULL THEN 0.5 * l1 + 0.5 * l2 ELSE 0.2 * l1 + 0.35 * l2 + 0.45 * l3 END)) AS fused, n_chars FROM p)
SELECT doc_id, layers, round(fused, 6) AS fused, CASE WHEN n_chars < 300 THEN 'UNCERTAIN' WHEN fused >= 0.7 THEN 'AI' WHEN fused <= 0.3 THEN 'HUMAN' ELSE 'UNCERTAIN' END AS label,
  CASE WHEN 2 * abs(fused - 0.5) >= 0.6 THEN 'high' WHEN 2 * abs(fused - 0.5) >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM f""")
def layer_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-01 P-02 P-04 P-06: weights by the layers that ran, a gate for short texts, zone and confidence band."""
    l3 = F.when(F.col("doc_id") % 3 != 0, F.col("l3"))
    fused = clip(F.when(l3.isNull(), 0.5 * F.col("l1") + 0.5 * F.col("l2")).otherwise(0.2 * F.col("l1") + 0.35 * F.col("l2") + 0.45 * l3))
    d = scored(spark, sf_dir).select("doc_id", "n_chars", F.when(l3.isNull(), 2).otherwise(3).alias("layers"), fused.alias("f"))
    conf = 2 * F.abs(F.col("f") - 0.5)
    return d.select("doc_id", "layers", r6("f").alias("fused"), F.when(F.col("n_chars") < 300, "UNCERTAIN").otherwise(label_zone(F.col("f"), "detector")).alias("label"), F.when(conf >= 0.6, "high").when(conf >= 0.3, "medium").otherwise("low").alias("band"))


_LR = "(1 / (1 + exp(-(-3.0 + 2.5 * l1 + 1.5 * l2 + 2.0 * l3))))"


@query(f"WITH {SCORED} SELECT doc_id, round(greatest(0.01, least(0.99, {_LR})), 6) AS p FROM scored")
def logistic_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-07: a logistic combination of layer scores; the coefficients are a parameter."""
    z = -3.0 + 2.5 * F.col("l1") + 1.5 * F.col("l2") + 2.0 * F.col("l3")
    return scored(spark, sf_dir).select("doc_id", r6(clip(1 / (1 + F.exp(-z)))).alias("p"))


@query(f"""WITH {SCORED}, v AS (SELECT doc_id, [l1, l2, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE l3 END, 0.5] AS s, [1.0, 1.0, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END, 0.0] AS ok FROM scored),
k AS (SELECT *, list_filter(s, lambda x, i: ok[i] > 0.5) AS good FROM v), m AS (SELECT *, list_sum(good) / len(good) AS mean FROM k)
SELECT doc_id, round(s[1], 6) AS f1, round(s[2], 6) AS f2, round(s[3], 6) AS f3, round(s[4], 6) AS f4, round(list_sum(ok)::DOUBLE, 6) AS n_ok, round(sqrt(list_sum(list_transform(good, lambda x: (x - mean) * (x - mean))) / len(good)), 6) AS spread FROM m""")
def layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-08 P-09: layer scores with defaults, which ran, and their spread over those that ran."""
    third = F.col("doc_id") % 3 == 0
    d = scored(spark, sf_dir).select("doc_id", F.array("l1", "l2", F.when(third, 0.5).otherwise(F.col("l3")), F.lit(0.5)).alias("s"), F.array(F.lit(1.0), F.lit(1.0), F.when(third, 0.0).otherwise(1.0), F.lit(0.0)).alias("ok"))
    good = F.filter("s", lambda x, i: F.get("ok", i) > 0.5)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    d = d.withColumn("good", good).withColumn("mean", mean(F.col("good")))
    spread = F.sqrt(F.aggregate("good", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("good"))
    return d.select("doc_id", *[r6(F.get("s", F.lit(i))).alias(f"f{i + 1}") for i in range(4)], r6(F.aggregate("ok", F.lit(0.0), lambda a, x: a + x)).alias("n_ok"), r6(spread).alias("spread"))


_TTR = r"len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) / nullif(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), 0)"
_N_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_RAN = "list_filter([a, b, c, d], lambda x: x IS NOT NULL)"


@query(rf"""WITH {SCORED}, f AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 5 <> 0 THEN l1 END AS a, CASE WHEN doc_id % 30 <> 1 THEN l2 END AS b, CASE WHEN doc_id % 3 <> 0 THEN l3 END AS c, CASE WHEN doc_id % 2 = 0 THEN 1 - l1 END AS d, CASE WHEN doc_id % 7 <> 0 THEN 20 + 100 * l2 END AS ppl,
  {_TTR} AS ttr, len(list_filter(string_split(coalesce(text, ''), '.'), lambda p: {_N_WORDS.format('p')} >= 4)) AS ns, {_N_WORDS.format("coalesce(text, '')")} AS nw FROM scored JOIN documents USING (doc_id)),
g AS (SELECT *, greatest(ns, 1) AS n, list_avg({_RAN}) AS m FROM f)
SELECT doc_id, list_transform(CAST([coalesce(a, 0.5), coalesce(b, 0.5), coalesce(c, 0.5), coalesce(d, 0.5), (a IS NOT NULL)::INT, (b IS NOT NULL)::INT, (c IS NOT NULL)::INT, (d IS NOT NULL)::INT, CASE WHEN a IS NULL THEN 80 ELSE coalesce(ppl, 80) END, 30, 30, 0.3, nw / n, 5,
  0.01, 0.01, CASE WHEN b IS NULL THEN 0.6 ELSE coalesce(ttr, 0.6) END, 0, 0.05, 0.7, coalesce(c, 0.5), coalesce(d, 0.5), nw, n, nw / n, CASE WHEN len({_RAN}) > 0 THEN sqrt(list_avg(list_transform({_RAN}, lambda x: (x - m) * (x - m)))) ELSE 0 END] AS DOUBLE[]), lambda x: round(x, 6)) AS features FROM g""")
def layer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-08: 26 features of layers of which some did not run or gave no evidence, and of the text."""
    d, words = scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), tokens(F.col("text"))
    i = F.col("doc_id")
    scores = {"perplexity": F.when(i % 5 != 0, F.col("l1")), "stylometry": F.when(i % 30 != 1, F.col("l2")), "transformer": F.when(i % 3 != 0, F.col("l3")), "adversarial": F.when(i % 2 == 0, 1 - F.col("l1"))}
    evidence = {"mean_perplexity": F.when(i % 7 != 0, 20 + 100 * F.col("l2")), "type_token_ratio": F.try_divide(F.size(F.array_distinct(words)), F.size(words)), "doc_score_l3": scores["transformer"], "doc_score_l4": scores["adversarial"]}
    return d.select("doc_id", F.transform(layer_vector(scores, evidence, F.col("text")), r6).alias("features"))


_DET = "CASE WHEN {0} AND NOT {1} THEN {2} ELSE {3} END"
_IMG, _VID, _BAD = "(doc_id % 3 = 0)", "(doc_id % 4 = 1)", "(doc_id % 6 = 0)"


@query(f"""WITH {SCORED}, f AS (SELECT doc_id, toxic, l1, {_DET.format(_IMG, _BAD, 'l2', '0.5')} AS im, {_DET.format(_VID, 'false', 'l3', '0.5')} AS vi, {_DET.format(_IMG, _BAD, '0.9', '0')} AS ci, {_DET.format(_VID, 'false', '0.7', '0')} AS cv, {_BAD}::INT AS bad, {_VID}::INT AS v, l2, l3 FROM scored),
g AS (SELECT *, CASE WHEN bad = 1 THEN [l1, vi, 0.5, 0.5] ELSE [l1, im, vi, 0.5, 0.5] END AS ok FROM f)
SELECT doc_id, list_transform(CAST([l1, im, vi, 0.5, 0.5, 0.8, ci, cv, 0, 0, 0, bad, 0, 0, 0, list_avg(ok), list_max(ok), list_min(ok), sqrt(list_avg(list_transform(ok, lambda x: (x - list_avg(ok)) * (x - list_avg(ok))))), (coalesce(toxic, 0) = 1)::INT, (doc_id % 11 = 0)::INT, (doc_id % 13 = 0)::INT,
  1 - v, 0, v, 0, 0, 2 * v, CASE WHEN v = 1 THEN greatest(l2, l3) ELSE 0 END] AS DOUBLE[]), lambda x: round(x, 6)) AS features FROM g""")
def detector_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-09: 29 features of the detectors that ran on a job, one of them failed on some; videos come with two flagged segments."""
    i, c = F.col("doc_id"), F.col
    of = lambda kind, score, sure, error, flagged: F.struct(F.lit(kind).alias("type"), score.alias("score"), F.lit(sure).alias("confidence"), error.alias("error"), flagged.alias("flagged"))
    none = F.array().cast("array<double>")
    all_ = F.array(F.when(i % 4 == 1, of("video", c("l3"), 0.7, F.lit(False), F.array("l2", "l3"))), of("text", c("l1"), 0.8, F.lit(False), none), F.when(i % 3 == 0, of("image", c("l2"), 0.9, i % 6 == 0, none)))
    v = detector_vector(F.filter(all_, lambda o: o.isNotNull()), c("toxic") == 1, i % 11 == 0, i % 13 == 0)
    return scored(spark, sf_dir).select("doc_id", F.transform(v, r6).alias("features"))


@query(f"""WITH {SCORED}, a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE (0.35 * l1 + 0.25 * l2 + CASE WHEN doc_id % 3 <> 0 THEN 0.2 * l3 ELSE 0 END) / (0.6 + CASE WHEN doc_id % 3 <> 0 THEN 0.2 ELSE 0 END) END AS avg_, toxic, n_chars FROM scored)
SELECT doc_id, round(avg_, 9) AS base, round(greatest(0.01, least(0.99, avg_ + CASE WHEN toxic = 1 THEN 0.1 ELSE 0 END + CASE WHEN n_chars > 5000 THEN 0.06 ELSE 0 END - CASE WHEN n_chars < 500 THEN 0.04 ELSE 0 END)), 9) AS engine,
  round(greatest(0.01, least(0.99, avg_ + CASE WHEN toxic = 1 THEN 0.15 ELSE 0 END + 0.08 * least(n_chars // 2000, 3) / 3 - CASE WHEN n_chars < 500 THEN 0.05 ELSE 0 END)), 9) AS result FROM a""")
def detector_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10 P-11: mean over detectors that ran, then the two sets of metadata adjustments."""
    alive = F.col("doc_id") % 5 != 0
    base = e.weighted_mean([(F.col("l1"), alive, 0.35), (F.col("l2"), alive, 0.25), (F.col("l3"), alive & (F.col("doc_id") % 3 != 0), 0.20)])
    toxic, short, zero = F.col("toxic") == 1, F.col("n_chars") < 500, F.lit(0.0)
    d = scored(spark, sf_dir).withColumn("base", base)
    engine = F.col("base") + F.when(toxic, 0.10).otherwise(zero) + F.when(F.col("n_chars") > 5000, 0.06).otherwise(zero) - F.when(short, 0.04).otherwise(zero)
    result = F.col("base") + F.when(toxic, 0.15).otherwise(zero) + 0.08 * F.least(F.floor(F.col("n_chars") / 2000), F.lit(3)) / 3 - F.when(short, 0.05).otherwise(zero)
    return d.select("doc_id", F.round("base", 9).alias("base"), F.round(clip(engine), 9).alias("engine"), F.round(clip(result), 9).alias("result"))


@query(f"""WITH {SCORED}, f AS (SELECT doc_id, s, CASE WHEN toxic = 1 AND l2 > 0.7 THEN l2 ELSE 0 END AS w, doc_id % 7 = 0 AS ai, doc_id % 4 = 0 AS cam, doc_id % 13 = 0 AS ok, doc_id % 2 = 1 AS img, doc_id % 5 AS signs FROM fused)
SELECT doc_id, round(greatest(0.01, least(0.99, s + 0.1 * w + 0.06 * ai::INT - 0.04 * cam::INT - 0.15 * ok::INT)), 6) AS engine,
  round(greatest(0.01, least(0.99, s + 0.15 * w + CASE WHEN ai AND img THEN 0.08 * least(signs, 3) / 3 WHEN cam THEN -0.05 ELSE 0 END - 0.2 * ok::INT)), 6) AS result FROM f""")
def metadata_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11: both adjusters with all their terms; the signs come from ids and labels."""
    i = F.col("doc_id")
    signs = {"watermark": F.when(F.col("toxic") == 1, F.col("l2")), "ai_device": i % 7 == 0, "camera": i % 4 == 0, "verified": i % 13 == 0, "image": i % 2 == 1, "suspicious": i % 5}
    return scored(spark, sf_dir).select("doc_id", *[r6(metadata_adjusted(F.col("s"), rule, **signs)).alias(rule) for rule in ("engine", "result")])


@query(f"""WITH {SCORED} SELECT doc_id, (l1 >= 0.45) AS deep, round(CASE WHEN l1 >= 0.45 THEN greatest(0.01, least(0.99, 0.2 * l1 + 0.8 * l3)) ELSE greatest(0.01, least(0.99, l1)) END, 6) AS final FROM scored""")
def tier_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07: the slow scorer only where the fast one says so; two branches, so that it runs on routed rows alone."""
    d = scored(spark, sf_dir)
    deep = d.where("l1 >= 0.45").select("doc_id", F.lit(True).alias("deep"), r6(clip(0.2 * F.col("l1") + 0.8 * F.col("l3"))).alias("final"))
    return deep.unionByName(d.where("l1 < 0.45").select("doc_id", F.lit(False).alias("deep"), r6(clip(F.col("l1"))).alias("final")))


@query(f"""WITH {SCORED}, c AS (SELECT doc_id, s, [struct_pack(name := 'l1', c := 0.2 * (l1 - 0.5)), struct_pack(name := 'l2', c := 0.35 * (l2 - 0.5)), struct_pack(name := 'l3', c := 0.45 * (l3 - 0.5))] AS parts FROM fused),
t AS (SELECT doc_id, s, unnest(parts) AS p FROM c), r AS (SELECT doc_id, p.name AS name, p.c AS c, row_number() OVER (PARTITION BY doc_id ORDER BY abs(p.c) DESC, p.name) AS rank FROM t) SELECT doc_id, name, round(c, 6) AS contribution, rank FROM r WHERE rank <= 2""")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-20 O-04: signed contributions, the two largest."""
    parts = F.array(*[F.struct((-F.abs(w * (F.col(n) - 0.5))).alias("k"), F.lit(n).alias("name"), (w * (F.col(n) - 0.5)).alias("c")) for n, w in (("l1", 0.2), ("l2", 0.35), ("l3", 0.45))])
    top = scored(spark, sf_dir).select("doc_id", F.posexplode(F.slice(F.array_sort(parts), 1, 2)).alias("i", "p"))
    return top.select("doc_id", "p.name", r6("p.c").alias("contribution"), (F.col("i") + 1).alias("rank"))


@query(f"""WITH {SCORED}, a AS (SELECT doc_id, s, y, 2 * abs(s - 0.5) AS conf FROM fused) SELECT doc_id, list_filter([CASE WHEN conf < 0.55 THEN 'low_confidence' END, CASE WHEN y = 1 AND s < 0.6 THEN 'ai_low' END, CASE WHEN y = 0 AND s > 0.6 THEN 'human_high' END], lambda x: x IS NOT NULL)::VARCHAR[] AS flags FROM a""")
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-08 T-38: flags of a validation table."""
    s, y = F.col("s"), F.col("y")
    flags = F.array(F.when(2 * F.abs(s - 0.5) < 0.55, "low_confidence"), F.when((y == 1) & (s < 0.6), "ai_low"), F.when((y == 0) & (s > 0.6), "human_high"))
    return scored(spark, sf_dir).select("doc_id", F.array_compact(flags).alias("flags"))


@query(f"""WITH {SCORED}, m AS (SELECT *, greatest(-0.15, least(0.15, (toxic * 0.1 - 0.02))) AS meta, CASE WHEN doc_id % 7 = 0 THEN 0.08 ELSE 0 END AS mark, CASE WHEN doc_id % 11 = 0 THEN -0.2 WHEN doc_id % 11 = 1 THEN -0.05 ELSE 0 END AS prov, least(0.07, l2 * 0.07) AS cross_ FROM fused)
SELECT doc_id, round(greatest(0.01, least(0.99, s + meta + mark + prov + cross_)), 6) AS ai, round(1 - greatest(0.01, least(0.99, s + meta + mark + prov + cross_)), 6) AS authenticity, round(2 * abs(s - 0.5) * greatest(1 - 2 * abs(meta), 0.5), 6) AS confidence FROM m""")
def authenticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-13 P-15: a score moved by metadata, watermark, provenance and cross-modal evidence."""
    k, zero = F.col("doc_id"), F.lit(0.0)
    meta = F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.col("toxic") * 0.1 - 0.02))
    prov = F.when(k % 11 == 0, -0.2).when(k % 11 == 1, -0.05).otherwise(zero)
    d = scored(spark, sf_dir).withColumn("meta", meta)
    ai = clip(F.col("s") + F.col("meta") + F.when(k % 7 == 0, 0.08).otherwise(zero) + prov + F.least(F.lit(0.07), F.col("l2") * 0.07))
    return d.select("doc_id", r6(ai).alias("ai"), r6(1 - ai).alias("authenticity"), r6(2 * F.abs(F.col("s") - 0.5) * F.greatest(1 - 2 * F.abs("meta"), F.lit(0.5))).alias("confidence"))


@query(f"WITH {SCORED} SELECT source, count(*) AS n, (count(*) >= 20) AS retrain, CASE WHEN count(*) >= 20 THEN 'ready' ELSE 'skipped' END AS status FROM scored GROUP BY source")
def retraining_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13: enough new samples or not."""
    g = scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", "n", (F.col("n") >= 20).alias("retrain"), F.when(F.col("n") >= 20, "ready").otherwise("skipped").alias("status"))
