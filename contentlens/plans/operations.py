"""Operational queries: orders stand for jobs, customers for users, parts for uploads, pages for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions import signing, udfs
from contentlens.plans.base import query, r6, table
from contentlens.sources import database
from contentlens.streaming import claims

JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderdate AS created_at, o_totalprice AS price,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'image' WHEN '2-HIGH' THEN 'video' WHEN '3-MEDIUM' THEN 'audio' ELSE 'text' END AS content_type FROM orders),
results AS (SELECT l_orderkey AS job_id, avg(l_discount) * 10 AS score, count(*) AS parts FROM lineitem GROUP BY 1), now_ AS (SELECT max(o_orderdate) AS t FROM orders)"""

#: A key for the stand-in reports.
_KEY = "a key of the stand-in reports"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSING")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "image").when(p == "2-HIGH", "video").when(p == "3-MEDIUM", "audio").otherwise("text")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"), status.alias("status"), kind.alias("content_type")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg((F.avg("l_discount") * 10).alias("score"), F.count(F.lit(1)).alias("parts"))


def with_now(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds now: the last order's time, one row."""
    return df.crossJoin(F.broadcast(table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("now"))))


@query(f"WITH {JOBS} SELECT job_id, created_at, round(score, 6) AS score FROM jobs JOIN results USING (job_id) ORDER BY created_at DESC, job_id LIMIT 100")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01 O-03: the last jobs with a result."""
    j = jobs(spark, sf_dir).join(results(spark, sf_dir), "job_id").orderBy(F.desc("created_at"), "job_id").limit(100)
    return j.select("job_id", "created_at", r6("score").alias("score"))


@query(f"WITH {JOBS} SELECT jobs.job_id, status, round(score, 6) AS score, results.job_id IS NOT NULL AS has_result FROM jobs LEFT JOIN results USING (job_id)")
def jobs_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02: each job, with its result if there is one."""
    r = results(spark, sf_dir).withColumn("hit", F.lit(True))
    return jobs(spark, sf_dir).join(r, "job_id", "left").select("job_id", "status", r6("score").alias("score"), F.coalesce("hit", F.lit(False)).alias("has_result"))


@query(f"WITH {JOBS} SELECT job_id, user_id FROM jobs WHERE job_id IN (SELECT job_id FROM results WHERE parts >= 6) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03: by membership, without collecting ids."""
    many, poor = results(spark, sf_dir).where("parts >= 6"), table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return jobs(spark, sf_dir).join(many, "job_id", "left_semi").join(poor, "user_id", "left_anti").select("job_id", "user_id")


@query(f"""WITH {JOBS}, h AS (SELECT c_custkey AS user_id, c_mktsegment AS segment, c_acctbal > 0 AS active, CASE WHEN c_custkey % 2 = 0 THEN ['done', 'failed'] ELSE ['failed'] END AS events FROM customer)
SELECT job_id, user_id, segment FROM jobs JOIN h USING (user_id) WHERE active AND list_contains(events, 'done') AND status = 'COMPLETED'""")
def webhook_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05 F-13: hooks that are active and ask for the event."""
    even = F.col("c_custkey") % 2 == 0
    hooks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("active"), F.when(even, F.array(F.lit("done"), F.lit("failed"))).otherwise(F.array(F.lit("failed"))).alias("events"))
    return jobs(spark, sf_dir).where("status = 'COMPLETED'").join(hooks.where(F.col("active") & F.array_contains("events", "done")), "user_id").select("job_id", "user_id", "segment")


@query(f"WITH {JOBS} SELECT status, content_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM jobs GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23 A-30 A-32 R-08: jobs by status and queue."""
    j = jobs(spark, sf_dir)
    total = j.agg(F.count(F.lit(1)).alias("total"))  # one row
    return j.groupBy("status", "content_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("status", "content_type", "n", r6(F.col("n") / F.col("total")).alias("share"))


@query(f"""WITH {JOBS} SELECT user_id, count(*) AS total, count(*) FILTER (WHERE date_trunc('month', created_at) = (SELECT date_trunc('month', t) FROM now_)) AS this_month, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  round(avg(score), 9) AS mean_score, count(*) FILTER (WHERE score >= 0.7) AS n_ai FROM jobs LEFT JOIN results USING (job_id) GROUP BY 1""")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: totals, this month, labels and mean score of a user."""
    j = with_now(jobs(spark, sf_dir).join(results(spark, sf_dir), "job_id", "left"), spark, sf_dir)
    month = F.date_trunc("month", "created_at") == F.date_trunc("month", "now")
    likely = F.round("score", 9) >= 0.7  # a mean of .7 has it in any order of its sum
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(month).alias("this_month"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.round(F.avg("score"), 9).alias("mean_score"), F.count_if(likely).alias("n_ai"))


@query(f"WITH {JOBS} SELECT job_id, (created_at < (SELECT t FROM now_) - INTERVAL 365 DAY AND price > 1000) AS expired FROM jobs")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: older than the limit, with something stored."""
    j = with_now(jobs(spark, sf_dir), spark, sf_dir)
    return j.select("job_id", ((F.col("created_at") < F.col("now") - F.expr("INTERVAL 365 DAYS")) & (F.col("price") > 1000)).alias("expired"))


@query(f"""WITH {JOBS} SELECT job_id, status AS before, CASE WHEN status = 'PROCESSING' AND created_at < (SELECT t FROM now_) - INTERVAL 10 DAY THEN 'FAILED' WHEN status = 'PENDING' AND created_at < (SELECT t FROM now_) - INTERVAL 30 DAY THEN 'FAILED' ELSE status END AS after FROM jobs""")
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-12 R-09: jobs that have waited or run too long fail; days stand for minutes."""
    j = with_now(jobs(spark, sf_dir), spark, sf_dir)
    old = lambda d: F.col("created_at") < F.col("now") - F.expr(f"INTERVAL {d} DAYS")
    late = ((F.col("status") == "PROCESSING") & old(10)) | ((F.col("status") == "PENDING") & old(30))
    return j.select("job_id", F.col("status").alias("before"), F.when(late, "FAILED").otherwise(F.col("status")).alias("after"))


@query(f"""WITH {JOBS}, r(content_type, queue, priority) AS (VALUES ('text', 'text', 9), ('image', 'image', 5), ('video', 'video', 1), ('audio', 'audio', 5)) SELECT job_id, queue, priority + (price > 100000)::INT AS priority FROM jobs LEFT JOIN r USING (content_type)""")
def queue_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08 J-09: queue and priority by kind."""
    routes = {"text": 9, "image": 5, "video": 1, "audio": 5}
    priority = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return jobs(spark, sf_dir).select("job_id", F.col("content_type").alias("queue"), (F.element_at(priority, F.col("content_type")) + (F.col("price") > 100000).cast("int")).alias("priority"))


@query(r"""WITH u AS (SELECT p_partkey AS id, lower(trim(string_split(p_type || '; v=1', ';')[1])) AS kind, p_retailprice * 1000 AS bytes FROM part), a(kind, most) AS (SELECT unnest(['economy', 'standard', 'promo']), unnest([1200000, 1400000, 1600000]))
SELECT id, string_split(u.kind, ' ')[1] AS family, a.kind IS NOT NULL AS allowed, coalesce(bytes <= most, false) AS fits FROM u LEFT JOIN a ON a.kind = string_split(u.kind, ' ')[1]""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09: a normalised type, whether it is allowed, and whether the file is small enough."""
    limits = F.create_map(*[F.lit(x) for kv in (("economy", 1200000), ("standard", 1400000), ("promo", 1600000)) for x in kv])
    kind = F.lower(F.trim(F.get(F.split(F.concat("p_type", F.lit("; v=1")), ";"), F.lit(0))))
    u = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.split(kind, " "), F.lit(0)).alias("family"), (F.col("p_retailprice") * 1000).alias("bytes"))
    most = F.try_element_at(limits, F.col("family"))
    return u.select("id", "family", most.isNotNull().alias("allowed"), F.coalesce(F.col("bytes") <= most, F.lit(False)).alias("fits"))


@query("""WITH u AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FF' WHEN 2 THEN '474946383961' WHEN 3 THEN '255044462D' ELSE '52494646' END || hex(p_name) AS digits,
  CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM part)
SELECT id, mime, CASE mime WHEN 'image/png' THEN digits LIKE '89504E470D0A1A0A%' WHEN 'image/gif' THEN digits LIKE '474946383761%' OR digits LIKE '474946383961%' WHEN 'application/pdf' THEN digits LIKE '255044462D%' ELSE true END AS ok FROM u""")
def upload_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-10: whether the first bytes of an upload open a file of the type that it claims."""
    openings, mimes = ("89504e470d0a1a0a", "ffd8ff", "474946383961", "255044462d", "52494646"), ("image/png", "image/gif", "application/pdf", "text/plain")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    head, mime = F.unhex(pick(openings, F.col("p_partkey") % 5)), pick(mimes, F.col("p_size") % 4)
    u = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), mime.alias("mime"), F.concat(head, F.encode("p_name", "UTF-8")).alias("data"))
    return u.select("id", "mime", udfs.signature_ok(F.col("data"), F.col("mime")).alias("ok"))


@query("SELECT c_custkey AS id, c_name AS name, '***' AS \"userPassword\", '***' AS \"API_TOKEN\", c_mktsegment AS segment, '***' AS authorization FROM customer")
def redacted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14: values under sensitive keys are blanked, whatever their case."""
    fields = {"name": "c_name", "userPassword": "c_name", "API_TOKEN": "c_acctbal", "segment": "c_mktsegment", "authorization": "c_nationkey"}
    c = table(spark, sf_dir, "customer")
    c = c.select(F.col("c_custkey").alias("id"), udfs.redact(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.col(v).cast("string"))])).alias("m"))
    return c.select("id", *[F.col("m")[k].alias(k) for k in fields])


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]+', ''), '/'), lambda x: x <> '' AND x NOT IN ('api', 'v1', 'v2')) AS parts, url FROM pages)
SELECT page_id, coalesce(parts[1], 'root') AS resource, regexp_replace(url, '[0-9]+', '{id}', 'g') AS template FROM p""")
def request_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-15: the resource of a path, and the path with its ids blanked."""
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "/"), lambda x: (x != "") & ~x.isin("api", "v1", "v2"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(parts, F.lit(0)), F.lit("root")).alias("resource"), F.regexp_replace("url", "[0-9]+", "{id}").alias("template"))


@query(f"WITH {JOBS} SELECT user_id, count(*) AS jobs, CAST(coalesce(sum(parts), 0) AS BIGINT) AS results, list(job_id ORDER BY job_id)[1:1000] AS audit FROM jobs LEFT JOIN results USING (job_id) GROUP BY 1")
def erasure_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-04 D-17: what would be erased for each user with jobs, with at most a thousand audit rows."""
    j = jobs(spark, sf_dir)
    counts = j.join(results(spark, sf_dir), "job_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("parts"), F.lit(0)).alias("results"))
    # the limit on the rank holds before the shuffle, so no group meets more than a thousand rows of a task
    first = j.select("user_id", "job_id").withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("job_id"))).where("i <= 1000")
    audit = first.groupBy(F.col("user_id").alias("of")).agg(F.array_sort(F.collect_list("job_id")).alias("audit"))
    return counts.join(audit, F.col("user_id").eqNullSafe(F.col("of"))).select("user_id", "jobs", "results", "audit")


@query(f"""WITH {JOBS} SELECT job_id, '{{"job_id":' || job_id || ',"status":"' || status || '","content":"' || content_type || '"}}' AS report, sha256(job_id || ':' || status) AS signature FROM jobs""")
def job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15 D-18: a report as JSON and a hash of what it says."""
    report = F.to_json(F.struct("job_id", "status", F.col("content_type").alias("content")))
    return jobs(spark, sf_dir).select("job_id", report.alias("report"), F.sha2(F.concat_ws(":", "job_id", "status"), 256).alias("signature"))


@query(f"""WITH {JOBS} SELECT job_id, sha256(unhex('{signing.pads(_KEY)[1].hex()}') || unhex(sha256(unhex('{signing.pads(_KEY)[0].hex()}') || encode(job_id || ':' || status || ':' || content_type)))) AS signature FROM jobs""")
def signed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-43: HMAC-SHA256 of what a report says."""
    return jobs(spark, sf_dir).select("job_id", signing.sign(F.concat_ws(":", "job_id", "status", "content_type"), _KEY).alias("signature"))


@query(f"""WITH {JOBS}, c AS (SELECT md5(content_type || (user_id % 100)) AS key, job_id, created_at, CASE content_type WHEN 'text' THEN 30 WHEN 'image' THEN 7 ELSE 1 END AS ttl FROM jobs), f AS (SELECT *, lag(created_at) OVER (PARTITION BY key ORDER BY created_at, job_id) AS before FROM c)
SELECT job_id, coalesce(created_at <= before + to_days(ttl), false) AS hit FROM f""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-18: whether the same content was seen within its time to live."""
    ttl = F.when(F.col("content_type") == "text", 30).when(F.col("content_type") == "image", 7).otherwise(1)
    j = jobs(spark, sf_dir).withColumn("key", F.md5(F.concat("content_type", (F.col("user_id") % 100).cast("string")).cast("binary"))).withColumn("ttl", ttl)
    before = F.lag("created_at").over(W.partitionBy("key").orderBy("created_at", "job_id"))
    return j.withColumn("before", before).select("job_id", F.coalesce(F.col("created_at") <= F.col("before") + F.make_interval(days=F.col("ttl")), F.lit(False)).alias("hit"))


@query(f"""WITH {JOBS}, k AS (SELECT user_id, count(*) AS runs, count(DISTINCT status) AS states, bool_and(status = 'COMPLETED') AS all_done FROM jobs GROUP BY 1) SELECT user_id, runs, all_done, (states = 1 AND runs > 1) AS consistent FROM k""")
def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-09: whether repeated runs agree."""
    k = jobs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("status").alias("states"), F.bool_and(F.col("status") == "COMPLETED").alias("all_done"))
    return k.select("user_id", "runs", "all_done", ((F.col("states") == 1) & (F.col("runs") > 1)).alias("consistent"))


@query(f"""WITH {JOBS}, b AS (SELECT user_id AS batch, count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS done, count(*) FILTER (WHERE status = 'PROCESSING') AS failed FROM jobs GROUP BY 1) SELECT batch, total, done, failed, round(100 * (done + failed) / total, 6) AS pct, (done + failed >= total) AS complete FROM b""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10: a batch is complete once done and failed reach its total."""
    s = F.col("status")
    b = jobs(spark, sf_dir).groupBy(F.col("user_id").alias("batch")).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "COMPLETED").alias("done"), F.count_if(s == "PROCESSING").alias("failed"))
    return b.select("*", r6(100 * (F.col("done") + F.col("failed")) / F.col("total")).alias("pct"), (F.col("done") + F.col("failed") >= F.col("total")).alias("complete"))


@query("""SELECT p_partkey AS model_id, p_name AS name, contains(lower(p_name), 'a') AS matches, (p_size > 30) AS stale FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), '#1')""")
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-16: by part of a name or family; those not renewed for thirty days are stale."""
    hit = F.contains(F.lower("p_name"), F.lit("a"))
    p = table(spark, sf_dir, "part").where(hit | F.contains(F.lower("p_brand"), F.lit("#1")))
    return p.select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("name"), hit.alias("matches"), (F.col("p_size") > 30).alias("stale"))


@query(f"""WITH {JOBS}, r AS (SELECT md5(content_type || job_id) AS content_hash, job_id, created_at FROM jobs), v AS (SELECT job_id, count(*) AS n FROM lineitem l JOIN jobs ON l.l_orderkey = jobs.job_id GROUP BY 1) SELECT r.content_hash, r.job_id, coalesce(v.n, 0) AS verifications FROM r LEFT JOIN v USING (job_id)""")
def passport_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-16 J-14: a registry keyed by content hash, with its verification records."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("n"))
    return jobs(spark, sf_dir).join(v, "job_id", "left").select(F.md5(F.concat("content_type", F.col("job_id").cast("string")).cast("binary")).alias("content_hash"), "job_id", F.coalesce("n", F.lit(0)).alias("verifications"))


@query(f"""WITH {JOBS} SELECT user_id, count(*) AS completed, count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-01-01') AS recent, count(score) AS n_results, round(avg(score), 9) AS mean_score
FROM jobs LEFT JOIN results USING (job_id) WHERE status = 'COMPLETED' GROUP BY 1""")
def database_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-13: completed jobs and their results, read from the tables of a database, which is filled first."""
    url = database.url_of(spark)
    database.write_table(jobs(spark, sf_dir), url, "jobs", "status VARCHAR(16), content_type VARCHAR(16)")
    database.write_table(results(spark, sf_dir), url, "results")
    done = database.read_table(spark, url, "jobs", "job_id").where("status = 'COMPLETED'").select("job_id", "user_id", "created_at")
    scores = database.read_table(spark, url, "results", "job_id").select("job_id", "score")
    recent = F.col("created_at") >= F.lit("2001-01-01").cast("timestamp")
    return done.join(scores, "job_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("completed"), F.count_if(recent).alias("recent"), F.count("score").alias("n_results"), F.round(F.avg("score"), 9).alias("mean_score"))


@query(f"""WITH RECURSIVE {JOBS}, j AS (SELECT job_id, status, job_id % 3 AS version, CASE WHEN status = 'PROCESSING' AND job_id % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(job_id % 500) END AS since FROM jobs),
c AS (SELECT event_id AS claim_id, user_id * 101 AS job_id, ts AS tm, event_id % 3 AS seen FROM events),
r AS (SELECT c.*, j.status, j.version, j.since, j.job_id IS NOT NULL AS known FROM c LEFT JOIN j USING (job_id)),
free AS (SELECT * FROM r WHERE status = 'PENDING' OR (status = 'PROCESSING' AND (since IS NULL OR tm >= since + INTERVAL 1 DAY))),
chain AS (SELECT job_id, min(tm) AS tm, 1 AS n FROM free GROUP BY 1 UNION ALL SELECT k.job_id, min(f.tm) AS tm, k.n + 1 AS n FROM chain k JOIN free f ON f.job_id = k.job_id AND f.tm >= k.tm + INTERVAL 1 DAY GROUP BY k.job_id, k.tm, k.n),
won AS (SELECT job_id, tm, n, min(claim_id) AS claim_id FROM chain JOIN r USING (job_id, tm) GROUP BY ALL)
SELECT r.claim_id, r.job_id, CASE WHEN NOT known THEN 'missing' WHEN n = 1 AND status = 'PENDING' THEN 'claimed' WHEN n IS NOT NULL THEN 'reclaimed' ELSE 'handled' END AS outcome, version + n AS version,
  CASE WHEN n = 1 AND status = 'PENDING' AND seen <> version THEN 2 ELSE 1 END AS attempts FROM r LEFT JOIN won USING (claim_id)""")
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-09: which claims on jobs win; events stand for claims, a day for the ten minutes after which a job is stale."""
    j = jobs(spark, sf_dir)
    since = F.when((F.col("status") == "PROCESSING") & (F.col("job_id") % 5 > 0), F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("job_id") % 500).cast("int")))
    j = j.select("job_id", "status", (F.col("job_id") % 3).alias("version"), since.alias("started_at"))
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), (F.col("user_id") * 101).alias("job_id"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("seen"))
    return claims.outcomes(j, c, 86_400_000_000).select("claim_id", "job_id", "outcome", "version", "attempts")
