"""Receipts and results of all users and jobs."""

import collections

from contentlens.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_job_keeps_its_result(spark):
    have = {r.l_orderkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    rows = registry.QUERIES["jobs_with_results"](spark, SF).collect()
    assert rows and any(r.job_id % 3 == 0 and r.has_result for r in rows)
    assert all(r.has_result == (r.job_id in have) == (r.score is not None) for r in rows)


def test_every_user_has_a_receipt(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    hot = orders.limit(1).selectExpr("explode(sequence(10000000, 10002499)) AS o_orderkey", "99999999L AS o_custkey", *[c for c in orders.columns if c not in ("o_orderkey", "o_custkey")])
    orders.unionByName(hot.select(*[hot[f.name].cast(f.dataType).alias(f.name) for f in orders.schema])).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = collections.Counter(r.l_orderkey for r in lines.select("l_orderkey").collect())
    own = collections.defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/orders.parquet").collect():
        own[r.o_custkey].append(r.o_orderkey)
    got = {r.user_id: (r.jobs, r.results, r.audit) for r in registry.QUERIES["erasure_receipts"](spark, str(tmp_path)).collect()}
    assert got == {u: (len(ids), sum(parts[i] for i in ids), sorted(ids)[:1000]) for u, ids in own.items()}
    assert got[99999999][0] == 2500 and len(got[99999999][2]) == 1000
