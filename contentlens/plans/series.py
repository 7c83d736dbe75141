"""Ordered queries over events, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions import evidence as v
from contentlens.functions.alignment import alignment
from contentlens.operators import series as s
from contentlens.operators.monitoring import linear_percentiles, nearest_rank
from contentlens.operators.spacing import spaced
from contentlens.plans.base import query, r6, table
from contentlens.streaming import calls

_MS = "e AS (SELECT event_id, user_id, event_type, value, ts, floor(epoch_us(ts) / 1000)::BIGINT AS ms FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", s.millis(F.col("ts")))


@query(f"WITH {_MS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS in_window, (count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) > 1) AS limited FROM e")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-13: requests of the last minute, rejected ones included."""
    e = _events(spark, sf_dir)
    n = s.sliding_count(e, "user_id", "ms")
    return e.select("event_id", n.alias("in_window")).withColumn("limited", F.col("in_window") > 1)


@query(f"""WITH {_MS}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 1800000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(ms) - min(ms) AS span_ms, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM k GROUP BY 1, 2""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04: sessions by half an hour of silence, and their summary."""
    k = s.sessions(_events(spark, sf_dir), "user_id", "ms", ["event_id"], 1_800_000)
    return k.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span_ms"), r6(F.avg("value")).alias("mean_value"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("""WITH o AS (SELECT *, value >= 100 AS flag, lead(event_id) OVER w AS nxt, lag(value >= 100) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS "start", coalesce(max_by(nxt, event_id), max(event_id)) AS "end", round(avg(value), 6) AS mean, round(max(value), 6) AS peak, CASE WHEN max(value) >= 200 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE flag GROUP BY 1, 2""")
def flagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-05 F-18: runs of flagged rows; a run ends at the first row past it."""
    r = s.flagged_runs(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 100)
    return r.withColumn("severity", F.when(F.col("peak") >= 200, "high").otherwise("medium")).withColumn("mean", r6("mean")).withColumn("peak", r6("peak"))


@query(f"""WITH {_MS}, d AS (SELECT user_id, value - lag(value) OVER w AS d1, ms, event_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), d2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS d2 FROM d)
SELECT user_id, round(stddev_pop(d1), 6) AS first_std, round(stddev_pop(d2), 6) AS second_std, count(d2) AS n FROM d2 GROUP BY 1""")
def score_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06: deviation of first and second differences."""
    d = s.differences(_events(spark, sf_dir), "user_id", ["ms", "event_id"], "value")
    return d.groupBy("user_id").agg(r6(F.stddev_pop("d1")).alias("first_std"), r6(F.stddev_pop("d2")).alias("second_std"), F.count("d2").alias("n"))


@query(f"""WITH {_MS}, g AS (SELECT user_id, ms, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM e), a AS (SELECT user_id, avg(gap) AS m, stddev_pop(gap) AS sd, count(*) AS n, max(ms) - min(ms) AS span FROM g GROUP BY 1)
SELECT user_id, round(sd / nullif(m, 0), 9) AS gap_cv, round(greatest(0, 1 - sd / nullif(m, 0)), 6) AS regularity, CASE WHEN span < 5000 THEN 0.5 ELSE round(n / (span / 60000.0::DOUBLE), 9) END AS per_minute FROM a""")
def interval_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-07: variation of intervals, and events a minute."""
    w = W.partitionBy("user_id").orderBy("ms", "event_id")
    g = _events(spark, sf_dir).select("user_id", "ms", (F.col("ms") - F.lag("ms").over(w)).alias("gap"))
    a = g.groupBy("user_id").agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span"))
    cv = F.try_divide("sd", "m")
    return a.select("user_id", F.round(cv, 9).alias("gap_cv"), r6(F.greatest(F.lit(0), 1 - cv)).alias("regularity"), F.when(F.col("span") < 5000, 0.5).otherwise(F.round(F.try_divide(F.col("n"), F.col("span") / 60000), 9)).alias("per_minute"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH p AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings),
c AS (SELECT label, {_DOT.format('u', 'v')} / (sqrt({_DOT.format('u', 'u')}) * sqrt({_DOT.format('v', 'v')})) AS cosine FROM p WHERE u IS NOT NULL) SELECT label, round(avg(1 - cosine), 6) AS drift, round(stddev_pop(cosine), 6) AS spread, count(*) AS n FROM c GROUP BY 1""")
def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-08: cosine from one vector to the next."""
    v = table(spark, sf_dir, "embeddings")
    p = v.select("label", "embedding", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id")).alias("before")).where("before is not null")
    c = p.select("label", s.cosine(F.col("before"), F.col("embedding")).alias("cosine"))
    return c.groupBy("label").agg(r6(F.avg(1 - F.col("cosine"))).alias("drift"), r6(F.stddev_pop("cosine")).alias("spread"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS rolling FROM e""")
def rolling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-09: mean of the last four."""
    return _events(spark, sf_dir).select("event_id", r6(s.rolling_mean("user_id", ["ms", "event_id"], "value")).alias("rolling"))


@query(f"""WITH {_MS}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) - 1 AS back FROM e) SELECT user_id, round(sum(0.15 * pow(0.85, back) * value), 6) AS ewma FROM r GROUP BY 1""")
def ewma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: exponentially weighted mean in closed form."""
    return s.ewma(_events(spark, sf_dir), "user_id", ["ms", "event_id"], "value").withColumn("ewma", r6("ewma"))


@query(f"""WITH RECURSIVE {_MS}, hot AS (SELECT DISTINCT user_id, ms FROM e WHERE value >= 100),
kept AS (SELECT user_id, min(ms) AS ms FROM hot GROUP BY 1 UNION ALL SELECT k.user_id, min(h.ms) AS ms FROM kept k JOIN hot h ON h.user_id = k.user_id AND h.ms >= k.ms + 3600000 GROUP BY k.user_id, k.ms)
SELECT user_id, ms FROM kept""")
def debounced_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11 W-12: alerts of a user at least an hour after the last one sent."""
    hot = _events(spark, sf_dir).where("value >= 100").select("user_id", "ms")
    return spaced(hot, "user_id", "ms", 3_600_000).select("k.user_id", F.col("t").alias("ms"))


@query("""WITH d AS (SELECT doc_id, n_chars / 15.0::DOUBLE AS total FROM documents), c AS (SELECT doc_id, total, unnest(range(0, greatest(ceil((total - 30) / 28), 0)::BIGINT + 1)) AS i FROM d)
SELECT doc_id, round(i * 28.0::DOUBLE, 6) AS "start", round(least(i * 28.0::DOUBLE + 30, total), 6) AS "end" FROM c""")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02: thirty-second chunks with two seconds of overlap; reading time stands for a duration."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.inline(s.chunks(F.col("n_chars") / 15)))
    return d.select("doc_id", r6(F.col("start").cast("double")).alias("start"), r6(F.col("end").cast("double")).alias("end"))


@query("""WITH p AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS pairs, round(corr(before, n), 6) AS r, CASE WHEN corr(before, n) < 0.3 THEN 'mismatch' ELSE 'consistent' END AS verdict FROM p WHERE before IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def series_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17 P-19: correlation of two aligned series of a conversation."""
    p = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("n"), F.lag(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before is not null")
    g = s.correlated(p, ["conv_id"], "before", "n", "c").where("pairs >= 3")
    return g.select("conv_id", "pairs", r6("c").alias("r"), F.when(F.col("c") < 0.3, "mismatch").otherwise("consistent").alias("verdict"))


@query("""WITH s AS (SELECT conv_id, list(CAST(length(text) % 97 AS DOUBLE) / 97 ORDER BY turn, text) FILTER (WHERE role = 'user') AS v, list(CAST(length(text) % 89 AS DOUBLE) / 89 ORDER BY turn, text) FILTER (WHERE role <> 'user') AS a FROM conversations WHERE text IS NOT NULL GROUP BY 1),
n AS (SELECT *, CASE WHEN len(v) >= 3 AND len(a) >= 3 THEN least(len(v), len(a), 20) ELSE 0 END AS n FROM s),
p AS (SELECT conv_id, n, v, a, i, i * (len(v) - 1)::DOUBLE / (n - 1) AS pv, i * (len(a) - 1)::DOUBLE / (n - 1) AS pa FROM (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 0)),
q AS (SELECT conv_id, n, v[floor(pv)::INT + 1] + (pv - floor(pv)) * (v[least(floor(pv)::INT + 2, len(v))] - v[floor(pv)::INT + 1]) AS x, a[floor(pa)::INT + 1] + (pa - floor(pa)) * (a[least(floor(pa)::INT + 2, len(a))] - a[floor(pa)::INT + 1]) AS y FROM p),
g AS (SELECT conv_id, abs(avg(x) - avg(y)) AS gap, CASE WHEN max(x) = min(x) OR max(y) = min(y) THEN 0 ELSE greatest(-1, least(1, corr(x, y))) END AS r FROM q GROUP BY 1)
SELECT n.conv_id, CAST(n AS INTEGER) AS points, round(coalesce((r + 1) / 2 * (1 - least(gap, 1)), 0.5), 6) AS consistency, coalesce(gap > 0.3 AND r < 0.3, false) AS mismatch,
  CASE WHEN gap > 0.5 THEN 'high' WHEN gap > 0.3 THEN 'medium' WHEN gap > 0.15 THEN 'low' ELSE 'none' END AS severity, round(r, 6) AS correlation, round(gap, 6) AS gap FROM n LEFT JOIN g USING (conv_id)""")
def cross_modal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17 P-19: two series of a conversation resampled to one length, their correlation and gap; the users' turns stand for video, the others' for audio."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    of = lambda asks, m: F.transform(F.array_sort(F.collect_list(F.when(asks, F.struct("turn", "text")))), lambda x: (F.length(x["text"]) % m).cast("double") / m)
    s = turns.groupBy("conv_id").agg(of(F.col("role") == "user", 97).alias("v"), of(F.col("role") != "user", 89).alias("a"))
    out = s.select("conv_id", *[c.alias(n) for n, c in alignment(F.col("v"), F.col("a")).items()])
    return out.withColumns({c: r6(c) for c in ("consistency", "correlation", "gap")})


@query(f"""WITH {_MS}, f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS a, count(DISTINCT event_type) AS kinds, stddev_pop(value) / avg(value) AS cv FROM e GROUP BY 1)
SELECT user_id, ((cv < 0.5)::INT + (a = 0)::INT + (kinds < 4)::INT) AS signs, ((cv < 0.5)::INT + (a = 0)::INT + (kinds < 4)::INT >= 2) AS agent FROM f""")
def agent_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-17: at least two signs of automation."""
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_distinct("event_type").alias("kinds"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))
    signs = (F.col("cv") < 0.5).cast("int") + (F.col("a") == 0).cast("int") + (F.col("kinds") < 4).cast("int")
    return f.select("user_id", signs.alias("signs"), (signs >= 2).alias("agent"))


_BOT = " OR ".join(f"contains(ua, '{w}')" for w in v.BOT_WORDS)


@query(f"""WITH f AS (SELECT user_id, stddev_pop(value) / greatest(avg(value), 1) AS cv, CASE WHEN user_id % 5 = 0 THEN 'python-client/3' WHEN user_id % 5 < 3 THEN 'mozilla/5.0' END AS ua, 1000 * min(value) AS ms, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, 100 * count(*) AS height FROM events GROUP BY 1),
s AS (SELECT user_id, list_filter([CASE WHEN cv < 0.15 THEN 'keystrokes' END, CASE WHEN {_BOT} THEN 'user_agent' END, CASE WHEN ms < 3000 AND kinds > 3 THEN 'fast_form' END, CASE WHEN clicks = 0 THEN 'no_mouse' END, CASE WHEN views = 0 AND height > 1000 THEN 'no_scroll' END], lambda x: x IS NOT NULL) AS s FROM f)
SELECT user_id, array_to_string(s, ',') AS signs, len(s) >= 2 AS agent, round(least(len(s) / 3, 1), 4) AS confidence, CASE WHEN len(s) >= 3 THEN 'high' WHEN len(s) = 2 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def agent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-17: all five signs of automation; a user's values, kinds of events and counts stand for keystrokes, fields and page height."""
    of = lambda kind: F.count_if(F.col("event_type") == kind) > 0
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.stddev_pop("value") / F.greatest(F.avg("value"), F.lit(1.0))).alias("cv"), (1000 * F.min("value")).alias("ms"), F.count_distinct("event_type").alias("kinds"),
        of("click").alias("mouse"), of("view").alias("scroll"), (100 * F.count(F.lit(1))).alias("height"),
    )
    agent = F.when(F.col("user_id") % 5 == 0, "Python-client/3").when(F.col("user_id") % 5 < 3, "Mozilla/5.0")
    d = f.select("user_id", v.agent_signs(F.col("cv"), agent, F.col("ms"), F.col("kinds"), F.col("mouse"), F.col("scroll"), F.col("height")).alias("s"))
    is_agent, sure, risk = v.agent_risk(F.col("s"))
    return d.select("user_id", F.array_join("s", ",").alias("signs"), is_agent.alias("agent"), F.round(sure, 4).alias("confidence"), risk.alias("risk"))


@query(f"""WITH {_MS}, r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) AS i, value FROM e), g AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg((value <= 100)::INT) AS on_time FROM r GROUP BY 1)
SELECT event_type, n, round(m, 6) AS mean, round(sd, 6) AS std, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(100 * on_time, 6) AS pct_on_time, (p95 <= 150) AS target_met FROM g""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25 D-11 D-12: linear percentiles and the share on time."""
    e = table(spark, sf_dir, "events").select(F.struct("event_type").alias("of"), "value")  # a struct: a null type joins itself
    g = e.groupBy("of").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), r6(100 * F.avg((F.col("value") <= 100).cast("double"))).alias("pct_on_time"),
    )
    p = linear_percentiles(e, ["of"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    out = g.join(p, "of", "left").select("of.event_type", "n", "mean", "std", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"), "pct_on_time")
    return out.withColumn("target_met", F.col("p95") <= 150)


@query(f"""WITH {_MS}, g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick, user_id % 4 AS worker, sum(value) AS rss, max(value) AS cpu FROM e GROUP BY 1, 2) SELECT tick, round(sum(rss), 6) AS rss_total, round(max(rss), 6) AS rss_max, round(avg(cpu), 6) AS cpu_mean, count(*) AS workers FROM g GROUP BY 1""")
def fleet_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-33: by worker and tick, then over workers."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), (F.col("user_id") % 4).alias("worker")).agg(F.sum("value").alias("rss"), F.max("value").alias("cpu"))
    return g.groupBy(F.col("w.start").alias("tick")).agg(r6(F.sum("rss")).alias("rss_total"), r6(F.max("rss")).alias("rss_max"), r6(F.avg("cpu")).alias("cpu_mean"), F.count(F.lit(1)).alias("workers"))


@query(f"""WITH {_MS}, r AS (SELECT CAST(ts AS DATE) AS day, value, event_type, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM e),
g AS (SELECT day, max(n) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY day)
SELECT day, n, errors, round(errors / n, 6) AS error_rate, round(p95, 6) AS p95, CASE WHEN n / 334.0 >= 0.95 AND p95 <= 150 AND errors < 30 THEN 'STABLE' WHEN n / 334.0 >= 0.75 THEN 'DEGRADED' ELSE 'SATURATED' END AS status, CAST(floor(n / 50.0 + 0.9999) AS BIGINT) AS pods FROM g""")
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26 P-28 P-29 D-10: load by day, its state and the pods it takes."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    g = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).join(nearest_rank(e, ["day"], "value", {"p95": 0.95}), "day")
    ratio = F.col("n") / 334
    status = F.when((ratio >= 0.95) & (F.col("p95") <= 150) & (F.col("errors") < 30), "STABLE").when(ratio >= 0.75, "DEGRADED").otherwise("SATURATED")
    return g.select("day", "n", "errors", r6(F.col("errors") / F.col("n")).alias("error_rate"), r6("p95").alias("p95"), status.alias("status"), F.floor(F.col("n") / 50 + 0.9999).alias("pods"))


@query(f"""WITH {_MS}, f AS (SELECT user_id AS call_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'frame' END AS kind, ms, 100 + event_id % 4000 AS len, value / 491 AS score FROM e),
g AS (SELECT *, CASE WHEN kind = 'start' OR lag(kind) OVER w = 'end' OR coalesce(ms - lag(ms) OVER w >= 1800000, true) THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY call_id ORDER BY ms, seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY ms, seq) AS session FROM g),
o AS (SELECT *, sum(len) OVER (PARTITION BY call_id, session ORDER BY ms, seq) - len AS off FROM s),
p AS (SELECT call_id, session, k, least(off + len, (k + 1) * 500) - greatest(off, k * 500) AS n, score FROM (SELECT *, unnest(range((off // 500)::BIGINT, ((off + len - 1) // 500 + 1)::BIGINT)) AS k FROM o)),
c AS (SELECT call_id, session, k, sum(n * score) / 500 AS score FROM p GROUP BY ALL HAVING sum(n) = 500),
m AS (SELECT *, avg(score) OVER (PARTITION BY call_id, session ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY call_id, session ORDER BY k DESC) - 1 AS back FROM c),
x AS (SELECT call_id, session, count(*) AS chunks, max(m) >= 0.75 AS flagged, sum(0.15 * pow(0.85, back) * m) AS final FROM m GROUP BY ALL)
SELECT call_id, min(ms) AS started_ms, max(ms) - min(ms) AS duration_ms, coalesce(any_value(chunks), 0) AS chunks, coalesce(any_value(flagged), false) AS flagged, round(coalesce(any_value(final), 0), 6) AS final_score
FROM o LEFT JOIN x USING (call_id, session) GROUP BY call_id, session""")
def call_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04: sessions by start, end and silence, their frames cut again at half a second; users stand for calls, events for frames."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").otherwise("frame")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts", (100 + F.col("event_id") % 4000).alias("len"), (F.col("value") / 491).alias("score"))
    return calls.summaries(e).withColumn("final_score", r6("final_score"))
