"""Monitoring queries: the prediction log by day, drift, calibration and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions.decisions import psi_class, trust_state
from contentlens.operators import monitoring as m
from contentlens.plans.base import query, r6, table
from contentlens.sources.predictions import SQL as PRED
from contentlens.sources.predictions import predictions

EDGES = [i / 10 for i in range(11)]
_BUCKET = "CASE WHEN p >= 0 AND p <= 0.1 THEN 0 " + " ".join(f"WHEN p > {EDGES[i]} AND p <= {EDGES[i + 1]} THEN {i}" for i in range(1, 10)) + " END"
#: The first ten days stand for the training distribution.
SPLIT = "2024-01-11"
_DAY0 = "(SELECT min(day) FROM predictions)"


@query(f"""WITH {PRED}, g AS (
  SELECT day, count(*) AS n_predictions, avg(p) AS mean_probability, CASE WHEN count(*) > 1 THEN stddev_pop(p) END AS probability_stddev,
    count(*) FILTER (WHERE final_label = 'AI') AS n_ai, count(*) FILTER (WHERE final_label = 'HUMAN') AS n_human, count(*) FILTER (WHERE final_label = 'UNCERTAIN') AS n_uncertain,
    avg(l1_score) AS l1_mean, avg(l2_score) AS l2_mean, avg(l3_score) AS l3_mean, avg(CASE WHEN l3_score IS NULL THEN 1.0 ELSE 0.0 END) AS fallback_rate,
    quantile_cont(input_length, 0.5) AS length_median, max(input_length) AS length_max
  FROM predictions GROUP BY day)
SELECT day, n_predictions, round(mean_probability, 6) AS mean_probability, round(probability_stddev, 6) AS probability_stddev, n_ai, n_human, n_uncertain,
  round(l1_mean, 6) AS l1_mean, round(l2_mean, 6) AS l2_mean, round(l3_mean, 6) AS l3_mean, round(fallback_rate, 6) AS fallback_rate, length_median, length_max,
  round(list_sum(list_transform([n_ai, n_human, n_uncertain], lambda c: CASE WHEN c > 0 THEN -(c / n_predictions) * log2(c / n_predictions) ELSE 0.0 END)), 6) AS entropy_bits,
  round(n_ai / n_predictions, 6) AS ai_fraction
FROM g""")
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01 A-02 A-03 A-07 R-06: one row a day."""
    d = m.day_metrics(predictions(spark, sf_dir))
    rounded = ("mean_probability", "probability_stddev", "l1_mean", "l2_mean", "l3_mean", "fallback_rate", "entropy_bits", "ai_fraction")
    return d.withColumns({c: r6(F.col(c)) for c in rounded})


@query(f"""WITH {PRED}, b AS (
  SELECT day, CASE WHEN input_length >= 10000 THEN '10000+' WHEN input_length >= 2000 THEN '2000-10000' WHEN input_length >= 500 THEN '500-2000' WHEN input_length >= 100 THEN '100-500' ELSE '0-100' END AS bucket FROM predictions),
names AS (SELECT unnest(['0-100', '100-500', '500-2000', '2000-10000', '10000+']) AS bucket)
SELECT d.day, n.bucket, count(b.day) AS n FROM (SELECT DISTINCT day FROM predictions) d CROSS JOIN names n LEFT JOIN b ON b.day = d.day AND b.bucket = n.bucket GROUP BY 1, 2""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04: lengths by day in [lo, hi) buckets, zeros included."""
    p = predictions(spark, sf_dir).withColumn("bucket", m.length_bucket(F.col("input_length")))
    names = [f"{a}-{b}" for a, b in zip(m.LENGTH_EDGES, m.LENGTH_EDGES[1:])] + [f"{m.LENGTH_EDGES[-1]}+"]
    wide = p.groupBy("day").agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])
    return wide.unpivot("day", names, "bucket", "n")


@query(f"""WITH {PRED}, r AS (
  SELECT event_type, input_length AS v, row_number() OVER (PARTITION BY event_type ORDER BY input_length) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM predictions)
SELECT event_type, max(v) FILTER (WHERE pos = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (WHERE pos = round_even(0.95 * (n - 1), 0)) AS p95,
  max(v) FILTER (WHERE pos = round_even(0.99 * (n - 1), 0)) AS p99, max(v) FILTER (WHERE pos = least(floor(n * 0.95), n - 1)) AS p95_floor,
  quantile_cont(v, 0.95) AS p95_linear, quantile_cont(v, 0.5) AS median
FROM r GROUP BY event_type""")
def percentile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05 A-06: nearest rank, floor index, linear and median."""
    p, key = predictions(spark, sf_dir), ["event_type"]
    near = m.nearest_rank(p, key, "input_length", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    floor = m.nearest_rank(p, key, "input_length", {"p95_floor": 0.95}, "floor")
    linear = m.linear_percentiles(p, key, "input_length", {"p95_linear": 0.95, "median": 0.5})
    return near.join(floor, key).join(linear, key)


def _histograms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf_dir)
    first = p.agg(F.min("day").alias("d0"))
    with_first = p.crossJoin(F.broadcast(first))  # broadcast: one row
    ref = m.bucket_counts(with_first.where("day < date_add(d0, 10)"), [], "p", EDGES)
    return ref, m.bucket_counts(with_first.where("day >= date_add(d0, 10)"), ["day"], "p", EDGES)


_PSI = f"""{PRED}, b AS (SELECT day, {_BUCKET} AS bucket FROM predictions),
nums AS (SELECT unnest(range(10)) AS bucket),
ref AS (SELECT n.bucket, count(b.day) AS c FROM nums n LEFT JOIN b ON b.bucket = n.bucket AND b.day < {_DAY0} + 10 GROUP BY 1),
prod AS (SELECT d.day, n.bucket, count(b.day) AS c FROM (SELECT DISTINCT day FROM predictions WHERE day >= {_DAY0} + 10) d CROSS JOIN nums n LEFT JOIN b ON b.day = d.day AND b.bucket = n.bucket GROUP BY 1, 2),
j AS (SELECT prod.day, prod.bucket, ref.c AS ref_count, prod.c AS prod_count,
  greatest(ref.c / greatest((SELECT sum(c) FROM ref), 1), 1e-6) AS q, greatest(prod.c / greatest(sum(prod.c) OVER (PARTITION BY prod.day), 1), 1e-6) AS p FROM prod JOIN ref USING (bucket)),
contrib AS (SELECT day, bucket, ref_count, prod_count, (p - q) * ln(p / q) AS contribution FROM j)"""


@query(f"WITH {_PSI} SELECT day, CAST(bucket AS INTEGER) AS bucket, ref_count, prod_count, round(contribution, 6) AS contribution FROM contrib")
def psi_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-08 A-09 J-11: what each bucket adds to drift."""
    return m.psi(*_histograms(spark, sf_dir), ["day"]).withColumn("contribution", r6(F.col("contribution")))


@query(f"""WITH {_PSI}, s AS (SELECT day, sum(contribution) AS psi FROM contrib GROUP BY day)
SELECT day, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS classification,
  CASE WHEN psi < 0.10 THEN 0 WHEN psi < 0.25 THEN 1 ELSE 2 END AS exit_code FROM s""")
def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09 P-25: drift of each day against the reference."""
    d = m.psi(*_histograms(spark, sf_dir), ["day"]).groupBy("day").agg(F.sum("contribution").alias("psi"))
    code = F.when(F.col("psi") < 0.10, 0).when(F.col("psi") < 0.25, 1).otherwise(2)
    return d.select("day", r6(F.col("psi")).alias("psi"), psi_class(F.col("psi")).alias("classification"), code.alias("exit_code"))


@query(f"""WITH {_PSI}, s AS (SELECT day, sum(contribution) AS psi FROM contrib GROUP BY day)
SELECT day AS latest_day, round(psi, 6) AS psi FROM s ORDER BY day DESC LIMIT 1""")
def latest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-16: the drift of the last day."""
    d = m.psi(*_histograms(spark, sf_dir), ["day"]).groupBy("day").agg(F.sum("contribution").alias("psi"))
    return d.agg(F.max("day").alias("latest_day"), r6(F.max_by("psi", "day")).alias("psi"))


@query(f"""WITH {PRED}, b AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM predictions GROUP BY 1)
SELECT CAST(b.bucket AS INTEGER) AS bucket, n AS count, round(n / (SELECT count(*) FROM predictions), 6) AS proportion,
  (SELECT round(min(p), 6) FROM predictions) AS p_min, (SELECT round(max(p), 6) FROM predictions) AS p_max, (SELECT round(avg(p), 6) FROM predictions) AS p_mean,
  (SELECT round(stddev_pop(p), 6) FROM predictions) AS p_std, (SELECT round(quantile_cont(p, 0.5), 6) FROM predictions) AS p_median
FROM b WHERE bucket IS NOT NULL""")
def reference_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10: histogram and moments that production is held against."""
    p = predictions(spark, sf_dir)
    stats = p.agg(
        r6(F.min("p")).alias("p_min"), r6(F.max("p")).alias("p_max"), r6(F.avg("p")).alias("p_mean"), r6(F.stddev_pop("p")).alias("p_std"),
        F.count(F.lit(1)).alias("n"),
    )
    median = m.linear_percentiles(p, [], "p", {"p_median": 0.5})
    stats = stats.crossJoin(F.broadcast(median.select(r6("p_median").alias("p_median"))))  # broadcast: one row
    counts = m.bucket_counts(p, [], "p", EDGES).where("count > 0")
    both = counts.crossJoin(F.broadcast(stats))  # broadcast: one row
    return both.withColumn("proportion", r6(F.col("count") / F.col("n"))).drop("n")


_Y = "CASE final_label WHEN 'AI' THEN 1.0 WHEN 'HUMAN' THEN 0.0 END"
_CAL = f"""{PRED}, r AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, p, {_Y} AS y FROM predictions),
g AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS fp FROM r GROUP BY bin),
bins AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count, coalesce(mp, (i + 0.5) / 10) AS mean_pred, CASE WHEN n IS NULL THEN 0.0 ELSE coalesce(fp, 0.5) END AS frac_pos FROM range(10) t(i) LEFT JOIN g ON g.bin = i)"""


def _proxy() -> F.Column:
    return F.when(F.col("final_label") == "AI", 1.0).when(F.col("final_label") == "HUMAN", 0.0)


@query(f"WITH {_CAL} SELECT bin, count, round(mean_pred, 6) AS mean_pred, round(frac_pos, 6) AS frac_pos FROM bins")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11: UNCERTAIN counts in mean and count, not in the share of positives."""
    bins = m.calibration_bins(predictions(spark, sf_dir), "p", _proxy())
    return bins.select("bin", "count", r6(F.col("mean_pred")).alias("mean_pred"), r6(F.col("frac_pos")).alias("frac_pos"))


def _ece_sql(name: str, n: int, at: str) -> str:
    return f"""SELECT '{name}' AS variant, round(sum(n * abs(mp - fp)) / sum(n), 6) AS ece, round(max(abs(mp - fp)), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT {at} AS bin, count(*) AS n, avg(p) AS mp, coalesce(avg(y), 0.5) AS fp FROM (SELECT p, {_Y} AS y FROM predictions) WHERE {at} BETWEEN 0 AND {n - 1} GROUP BY 1)"""


@query(f"WITH {PRED} " + " UNION ALL ".join([
    _ece_sql("ten_left_last_closed", 10, "least(floor(p * 10), 9)"), _ece_sql("fifteen_right", 15, "ceil(p * 15) - 1"),
    _ece_sql("fifteen_left_last_closed", 15, "least(floor(p * 15), 14)"), _ece_sql("fifteen_left_open", 15, "floor(p * 15)")]))
def ece_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12 A-13: the four binnings of expected and maximum calibration error."""
    p, out = predictions(spark, sf_dir), None
    for name, args in {"ten_left_last_closed": (10, "left", False), "fifteen_right": (15, "right", False), "fifteen_left_last_closed": (15, "left", False), "fifteen_left_open": (15, "left", True)}.items():
        one = m.ece_mce(m.calibration_bins(p, "p", _proxy(), *args)).select(F.lit(name).alias("variant"), r6(F.col("ece")).alias("ece"), r6(F.col("mce")).alias("mce"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PRED} SELECT event_type, round(avg(pow(p - {_Y}, 2)), 6) AS brier, count({_Y}) AS n FROM predictions GROUP BY event_type")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14: UNCERTAIN left out."""
    return predictions(spark, sf_dir).groupBy("event_type").agg(r6(F.avg(F.pow(F.col("p") - _proxy(), 2))).alias("brier"), F.count(_proxy()).alias("n"))


@query(f"""WITH {PRED}, g AS (SELECT day, count(*) FILTER (WHERE final_label <> 'UNCERTAIN') / count(*) AS coverage, avg(CASE WHEN final_label = 'UNCERTAIN' THEN NULL WHEN (final_label = 'AI') = (l1_score > 0.2) THEN 1.0 ELSE 0.0 END) AS reliability FROM predictions GROUP BY day)
SELECT day, round(coverage, 6) AS coverage, round(reliability, 6) AS reliability,
  CASE WHEN reliability IS NULL THEN 'gray' WHEN coverage >= 0.6 AND reliability >= 0.9 THEN 'green' WHEN coverage >= 0.4 AND reliability >= 0.7 THEN 'orange' ELSE 'red' END AS trust
FROM g""")
def coverage_and_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-01 P-26: share of definite labels by day, and the trust state (drift taken as stable)."""
    sure = F.col("final_label") != "UNCERTAIN"
    right = F.when(sure, ((F.col("final_label") == "AI") == (F.col("l1_score") > 0.2)).cast("double"))
    g = predictions(spark, sf_dir).groupBy("day").agg(F.avg(sure.cast("double")).alias("coverage"), F.avg(right).alias("reliability"))
    return g.select("day", r6(F.col("coverage")).alias("coverage"), r6(F.col("reliability")).alias("reliability"), trust_state(F.col("coverage"), F.col("reliability"), F.lit(0.0)).alias("trust"))


@query(f"""WITH {PRED} SELECT 'score' AS kind, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM predictions GROUP BY 2
UNION ALL SELECT 'margin', CAST(least(floor((round_even(p - 0.5, 4) + 0.5) * 40), 39) AS INTEGER), count(*) FROM predictions GROUP BY 2""")
def score_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-03 P-05: scores in 20 bins, margins in 40."""
    p = predictions(spark, sf_dir)
    margin = F.bround(F.col("p") - 0.5, 4)
    one = p.groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("score"))
    two = p.groupBy(F.least(F.floor((margin + 0.5) * 40), F.lit(39)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("margin"))
    return one.unionByName(two)


@query(f"""WITH {PRED} SELECT event_id, substr(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 1, 19) AS at, input_length // 5 AS words, printf('%.3f', p) AS probability, final_label, CAST(round(p - 0.5, 4) AS DOUBLE) AS margin
FROM predictions ORDER BY ts DESC, event_id DESC LIMIT 100""")
def latest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-15 D-02 S-04 O-03: the last hundred, as a dashboard shows them."""
    last = predictions(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.select(
        "event_id", F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), 1, 19).alias("at"), F.expr("input_length div 5").alias("words"),
        F.format_string("%.3f", "p").alias("probability"), "final_label", F.round(F.col("p") - 0.5, 4).alias("margin"),
    )


LATENCY = [10.0, 25.0, 50.0, 100.0, 250.0]
_CUM = "e AS (SELECT event_type, value FROM events), c AS (" + " UNION ALL ".join(f"SELECT event_type, {x}::DOUBLE AS le, count(*) FILTER (WHERE value <= {x}) AS n FROM e GROUP BY 1" for x in LATENCY) + " UNION ALL SELECT event_type, NULL, count(*) FROM e GROUP BY 1)"


@query(f"WITH {_CUM} SELECT event_type, le, n FROM c")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22 S-17: cumulative histogram buckets; the open one has no edge."""
    return m.cumulative_buckets(table(spark, sf_dir, "events"), ["event_type"], "value", LATENCY)


@query(f"""WITH {_CUM}, l AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo, max(n) OVER (PARTITION BY event_type) * 0.9 AS rank FROM c WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST))
SELECT event_type, round(min(CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * (rank - below) / (n - below) END), 9) AS quantile FROM l WHERE n >= rank AND below < rank GROUP BY event_type""")
def latency_bucket_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: the 0.9 quantile, interpolated in its bucket."""
    b = m.cumulative_buckets(table(spark, sf_dir, "events"), ["event_type"], "value", LATENCY)
    return m.bucket_quantile(b, ["event_type"], 0.9).withColumn("quantile", F.round("quantile", 9))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w5, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT w5 AS window_start, event_type, n, round(n / 300.0, 6) AS per_second, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY w5) AS BIGINT) AS counter FROM w""")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: rate and running counter by five-minute windows."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.partitionBy("event_type").orderBy("window_start"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n").withColumn("per_second", r6(F.col("n") / 300)).withColumn("counter", run)


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w5, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT w5 AS window_start, n, failed, round(failed / n, 6) AS failure_rate, (n >= 2 AND failed / n > 0.2) AS alert FROM w""")
def failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23 R-07: failure rate of five-minute windows, and whether it alerts."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    rate = F.col("failed") / F.col("n")
    return g.select(F.col("window.start").alias("window_start"), "n", "failed", r6(rate).alias("failure_rate"), ((F.col("n") >= 2) & (rate > 0.2)).alias("alert"))


@query(f"""WITH {PRED}, k AS (SELECT day, day - {_DAY0} AS i FROM predictions),
old AS (SELECT day, count(*) AS n, 1 AS version FROM k WHERE i < 20 GROUP BY day), new AS (SELECT day, count(*) * 10 AS n, 2 AS version FROM k WHERE i >= 15 GROUP BY day)
SELECT day, n, version FROM new UNION ALL SELECT day, n, version FROM old WHERE day NOT IN (SELECT day FROM new)""")
def metric_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10: days of a later run replace those of an earlier one, the rest stay."""
    p = predictions(spark, sf_dir)
    rows = p.crossJoin(F.broadcast(p.agg(F.min("day").alias("d0")))).withColumn("i", F.datediff("day", "d0"))  # broadcast: one row
    old = rows.where("i < 20").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("version"))
    new = rows.where("i >= 15").groupBy("day").agg((F.count(F.lit(1)) * 10).alias("n"), F.lit(2).alias("version"))
    return old.unionByName(new).groupBy("day").agg(F.max_by("n", "version").alias("n"), F.max("version").alias("version"))


@query(f"WITH {PRED} SELECT event_id, day FROM predictions WHERE day BETWEEN {_DAY0} + 3 AND {_DAY0} + 6")
def date_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-02: days lo to hi, both included."""
    p = predictions(spark, sf_dir)
    return p.crossJoin(F.broadcast(p.agg(F.min("day").alias("d0")))).where("day between date_add(d0, 3) and date_add(d0, 6)").select("event_id", "day")  # broadcast: one row


@query(f"""WITH {PRED}, g AS (SELECT event_type, round(100 * avg(CASE WHEN l3_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_pct, count(*) FILTER (WHERE l3_score IS NOT NULL) AS present, count(*) AS total FROM predictions GROUP BY 1)
SELECT * FROM g""")
def null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05: present values against all rows."""
    miss = F.col("l3_score").isNull()
    return predictions(spark, sf_dir).groupBy("event_type").agg(r6(100 * F.avg(miss.cast("double"))).alias("null_pct"), F.count("l3_score").alias("present"), F.count(F.lit(1)).alias("total"))


@query(f"""WITH {PRED} SELECT event_id, round(p, 6) AS p, round(abs(p - 0.5), 6) AS uncertainty, CASE WHEN p >= 0.5 THEN 'AI' ELSE 'HUMAN' END AS suggested
FROM predictions WHERE p BETWEEN 0.4 AND 0.6""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-06 O-02: scores near the middle, for review."""
    p = predictions(spark, sf_dir).where(F.col("p").between(0.4, 0.6))
    return p.select("event_id", r6(F.col("p")).alias("p"), r6(F.abs(F.col("p") - 0.5)).alias("uncertainty"), F.when(F.col("p") >= 0.5, "AI").otherwise("HUMAN").alias("suggested"))


@query(f"""WITH {PRED} SELECT event_type, count(*) FILTER (WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT % 10000 < 100) AS sampled, count(*) AS total FROM predictions GROUP BY 1""")
def sampled_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-12: the reproducible one per cent sample of the log."""
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10000
    return predictions(spark, sf_dir).groupBy("event_type").agg(F.count_if(h < 100).alias("sampled"), F.count(F.lit(1)).alias("total"))
