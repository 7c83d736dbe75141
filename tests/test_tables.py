"""Database tables, versioned tables, claims by version."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contentlens.plans import operations
from contentlens.sources import database, versioned
from contentlens.streaming import claims

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)
MIN = dt.timedelta(minutes=1)


def test_database_pushes_filters_and_splits(spark):
    url = database.url_of(spark)
    jobs = operations.jobs(spark, SF)
    database.write_table(jobs, url, "jobs_t", "status VARCHAR(16), content_type VARCHAR(16)", batch=100)
    back = database.read_table(spark, url, "jobs_t", "job_id", parts=4)
    assert back.rdd.getNumPartitions() == 4
    cut = F.lit("2000-01-01").cast("timestamp")
    some = lambda df: df.where((F.col("status") == "COMPLETED") & (F.col("created_at") >= cut)).select("job_id", "price")
    plan = some(back)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,COMPLETED)" in plan and "*GreaterThanOrEqual(" in plan and "content_type" not in plan.split("ReadSchema")[1]
    assert sorted(map(tuple, some(back).collect())) == sorted(map(tuple, some(jobs).collect()))
    assert back.count() == jobs.count()  # no row is lost at the ends of ranges


def test_database_odd_tables(spark):
    url = database.url_of(spark)
    empty = spark.createDataFrame([], "id long, v double")
    database.write_table(empty, url, "odd_t")
    assert database.read_table(spark, url, "odd_t", "id").count() == 0
    database.write_table(spark.createDataFrame([(None, 1.0), (5, None), (5, 2.0), (-9, 3.0)], "id long, v double"), url, "odd_t")
    assert sorted(map(repr, database.read_table(spark, url, "odd_t", "id", 3).collect())) == sorted(map(repr, spark.createDataFrame([(None, 1.0), (5, None), (5, 2.0), (-9, 3.0)], "id long, v double").collect()))


def test_versions_commit_once(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    assert versioned.read(spark, at) is None
    assert versioned.merge(spark, at, versioned.upsert("k", rows((1, "a"), (2, "b"))), 0) == 1
    assert versioned.merge(spark, at, versioned.upsert("k", rows((2, "c"), (3, None))), 1) == 2
    assert versioned.merge(spark, at, versioned.upsert("k", rows((2, "again"))), 1) is None  # a replay
    assert sorted(map(tuple, versioned.read(spark, at).collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert versioned.merge(spark, at, lambda t: t.where("k > 1"), 2) == 3 and len(list((tmp_path / "t").glob("data-*"))) == 2


def test_lost_races_are_tried_again(spark, tmp_path):
    """Another writer commits between reading and committing: the change is made on what it left; three losses are an error."""
    at, tries = str(tmp_path / "t"), []
    spark_rows = lambda n: spark.createDataFrame([(n, "x")], "k long, v string")
    versioned.merge(spark, at, versioned.upsert("k", spark_rows(0)))

    def racing(losses):
        def change(table):
            tries.append(table.count())
            if len(tries) <= losses:
                versioned.merge(spark, at, versioned.upsert("k", spark_rows(100 + len(tries))))
            return versioned.upsert("k", spark_rows(1))(table)

        return change

    versioned.merge(spark, at, racing(2))
    assert tries == [1, 2, 3] and versioned.read(spark, at).count() == 4
    tries.clear()
    with pytest.raises(versioned.Conflict):
        versioned.merge(spark, at, racing(9))


JOBS = "job_id long, status string, version long, started_at timestamp_ntz"
CLAIMS = "claim_id long, job_id long, at timestamp_ntz, seen long"


def played(jobs, rows, stale=10 * MIN):
    """Each claim in order of time against a table in memory."""
    table, out = {j[0]: list(j[1:]) for j in jobs}, {}
    for c, j, at, seen in sorted(rows, key=lambda r: (r[2], r[0])):
        if j not in table:
            out[c] = ("missing", None, 1)
            continue
        status, version, since = table[j]
        if status == "PENDING":
            out[c] = ("claimed", version + 1, 1 if seen == version else 2)
        elif status == "PROCESSING" and (since is None or at - since >= stale):
            out[c] = ("reclaimed", version + 1, 1)
        else:
            out[c] = ("handled", None, 1)
            continue
        table[j] = ["PROCESSING", version + 1, at]
    return out, {(j, *v) for j, v in table.items()}


@pytest.fixture
def world():
    rng = random.Random(4)
    jobs = [(j, rng.choice(["PENDING", "PROCESSING", "COMPLETED", "FAILED"]), rng.randrange(3), rng.choice([None, T0 - 5 * MIN, T0 - 60 * MIN])) for j in range(12)]
    rows = [(c, 3 if c % 3 == 0 else rng.randrange(14), T0 + rng.randrange(240) * MIN / 2, rng.randrange(3)) for c in range(200)]  # job 3 is hot
    return jobs, rows


def test_outcomes_against_a_table_in_memory(spark, world):
    jobs, rows = world
    got = claims.outcomes(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(rows, CLAIMS))
    want, after = played(jobs, rows)
    assert {r.claim_id: (r.outcome, r.version, r.attempts) for r in got.collect()} == want
    assert {tuple(r) for r in claims.applied(spark.createDataFrame(jobs, JOBS), got).collect()} == after


def test_claim_stream(spark, world, tmp_path):
    """Batches in order of time give what one table in memory gives; a replayed batch changes nothing."""
    jobs, rows = world
    rows.sort(key=lambda r: (r[2], r[0]))
    table, results = str(tmp_path / "jobs"), str(tmp_path / "results")
    versioned.merge(spark, table, lambda _: spark.createDataFrame(jobs, JOBS))
    for part in (rows[:70], rows[70:71], rows[71:]):
        spark.createDataFrame(part, CLAIMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CLAIMS).parquet(str(tmp_path / "in"))
        claims.claim_sink(stream, table, results, str(tmp_path / "ck")).awaitTermination(120)
    want, after = played(jobs, rows)
    state = lambda: {tuple(r) for r in versioned.read(spark, table).collect()}
    assert state() == after
    assert {r.claim_id: (r.outcome, r.version, r.attempts) for r in spark.read.parquet(results).collect()} == want
    # the last batch again, as after a failure before its commit was noted
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    claims.claim_sink(spark.readStream.schema(CLAIMS).parquet(str(tmp_path / "in")), table, results, str(tmp_path / "ck")).awaitTermination(120)
    assert state() == after


def test_two_claims_one_winner(spark):
    got = claims.outcomes(spark.createDataFrame([(1, "PENDING", 7, None)], JOBS), spark.createDataFrame([(2, 1, T0, 7), (1, 1, T0, 7), (3, None, T0, 7), (4, 1, None, 7)], CLAIMS))
    assert {r.claim_id: (r.outcome, r.version) for r in got.collect()} == {1: ("claimed", 8), 2: ("handled", None), 3: ("missing", None), 4: ("missing", None)}
