"""Sources, sinks and streams on temporary folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from contentlens.sources import files, versioned
from contentlens.streaming import jobs


def test_jsonl(spark, tmp_path):
    p = tmp_path / "2026-01-02.jsonl"
    p.write_text(json.dumps({"meta_probability": 0.5, "final_label": "AI"}) + "\n\nnot json\n" + json.dumps({"meta_probability": 0.1}) + "\n")
    (tmp_path / "2026-01-03.jsonl").write_text(json.dumps({"meta_probability": 0.9}) + "\n")
    (tmp_path / "2026-01-02.samples.jsonl").write_text(json.dumps({"meta_probability": 0.7}) + "\n")
    assert sorted(r.meta_probability for r in files.read_jsonl(spark, str(p)).where("meta_probability is not null").collect()) == [0.1, 0.5]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    days = files.read_days(spark, str(tmp_path), "2026-01-03", "2026-01-09")
    assert [(r.day, r.meta_probability) for r in days.collect()] == [("2026-01-03", 0.9)]


def test_parquet_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    files.upsert_days(df, str(tmp_path / "m"))
    files.upsert_days(spark.createDataFrame([("d2", 20), ("d3", 3)], "day string, n int"), str(tmp_path / "m"))
    assert sorted((r.day, r.n) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("d1", 1), ("d2", 20), ("d3", 3)]
    with pytest.raises(ValueError):
        files.read_parquet(spark, str(tmp_path / "m"), ["n", "missing"])
    files.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir()
    a, b = files.provenance(df, run="x").first(), files.provenance(df.orderBy(F.desc("n")), run="x").first()
    assert a == b and a.rows == 2
    assert files.file_hashes(spark, str(tmp_path / "s" / "split=train")).count() >= 1


def _events(spark, folder, rows, schema="event_id long, ts timestamp, user_id long, event_type string, value double"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_windows(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    _events(spark, tmp_path / "e", [(1, at(0), 1, "view", 1.0), (2, at(1), 1, "error", 3.0), (3, at(200), 1, "view", 5.0), (4, at(60 * 30), 2, "view", 1.0)])
    s = lambda: jobs.read(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    run(jobs.day_counts(s()), "days", "complete")
    assert {str(r.day): r.n for r in spark.table("days").collect()} == {"2026-01-01": 3, "2026-01-02": 1}
    run(jobs.failure_rates(s()), "rates", "complete")
    assert spark.table("rates").where("rate = 0.5").count() >= 1
    run(jobs.user_sessions(s()), "sessions", "complete")
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_log_sink_appends_once(spark, tmp_path):
    for k in (1, 2):
        _events(spark, tmp_path / "e", [(k, T0 + dt.timedelta(days=k), 1, "view", 1.0)])
        s = jobs.read(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
        jobs.log_sink(s, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
        jobs.upsert_sink(jobs.day_counts(s), str(tmp_path / "up"), str(tmp_path / "ck2"), "day").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert versioned.read(spark, str(tmp_path / "up")).count() == 2


def test_rolling_alerts(spark, tmp_path):
    rows = [(1, 1000 * i, s, T0 + dt.timedelta(seconds=i)) for i, s in enumerate([0.2, 0.9, 0.9, 0.9, 0.9, 0.95, 0.9, 0.9, 0.9, 0.9, 0.9])]
    _events(spark, tmp_path / "c", rows[:5], "call_id long, ms long, score double, ts timestamp")
    _events(spark, tmp_path / "c", rows[5:], "call_id long, ms long, score double, ts timestamp")
    s = jobs.read(spark, str(tmp_path / "c"), spark.read.parquet(str(tmp_path / "c")).schema, 1)
    run(jobs.rolling_alerts(s), "alerts")
    got = {r.ms: r for r in spark.table("alerts").collect()}
    scores, mean, last, want = [], 0.0, None, {}
    for _, ms, v, _ in sorted(rows, key=lambda r: r[1]):
        scores = [*scores, v][-4:]
        mean = 0.85 * mean + 0.15 * v
        alert = sum(scores) / len(scores) >= 0.75 and (last is None or ms - last >= 5000)
        last = ms if alert else last
        want[ms] = (pytest.approx(sum(scores) / len(scores)), pytest.approx(mean), alert)
    assert {m: (r.rolling, r.ewma, r.alert) for m, r in got.items()} == want
    kinds = [got[m].kind for m in sorted(got) if got[m].alert]
    assert kinds == ["voice_clone"] * 2 and all(r.kind is None for r in got.values() if not r.alert)
    assert jobs.alert_kind([0.6, 0.7, 0.9]) == jobs.alert_kind([]) == "ai_voice" and jobs.alert_kind([0.5, 0.95]) == "impersonation"


def test_facts_in_the_footers(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    at, facts = str(tmp_path / "f"), {"git_sha": "0" * 40, "written_at": "2026-01-01T00:00:00Z", "rows": "2"}
    files.write_with_facts(df, at, facts, {"n": {"unit": "documents"}})
    assert files.read_facts(spark, at) == (facts, {"n": {"unit": "documents"}})
    again = str(tmp_path / "g")
    spark.read.parquet(at).where("n > 1").write.parquet(again)  # facts survive another write
    assert files.read_facts(spark, again)[0] == facts and spark.read.parquet(again).count() == 1
    part = next((tmp_path / "f").glob("*.parquet"))
    assert facts["git_sha"] in pq.read_schema(part).metadata[b"org.apache.spark.sql.parquet.row.metadata"].decode()
    df.write.parquet(str(tmp_path / "h"))
    assert files.read_facts(spark, str(tmp_path / "h")) == ({}, {})
    with pytest.raises(ValueError):
        files.write_with_facts(df, at, facts, {"none": {}})


@pytest.mark.parametrize("key", ["", "key", "k" * 64, "k" * 65, "schlüssel"])
def test_hmac(spark, key):
    import hashlib
    import hmac

    from contentlens.functions.signing import sign

    texts = ["", "a", "x" * 1000, "ünï 🎉", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sign(F.col("t"), key).alias("s")).collect()]
    assert got == [None if t is None else hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]
