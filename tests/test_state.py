"""Streams with state: call sessions against their batch twin, and state that expires."""

import datetime as dt
import random
import time

import pytest

from contentlens.streaming import calls, expiring, jobs

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
FRAMES = "call_id long, seq long, kind string, ts timestamp, len long, score double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


@pytest.fixture
def no_idle_batches(spark):
    """State with a time to live asks for batches without data for ever; available-now would not end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def stream_of(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read(spark, folder, spark.read.parquet(folder).schema, 1)


def drain(df, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    ended = q.awaitTermination(100)
    q.stop()
    assert ended


def loop(rows):
    """One frame after another, all samples of a chunk written out."""
    state, out = {}, []

    def close(c):
        s = state.pop(c)
        out.append((c, s["start"], s["last"] - s["start"], s["chunks"], s["flag"], pytest.approx(s["mean"], abs=1e-12)))

    for c, seq, kind, ts, n, score in sorted((r for r in rows if r[0] is not None and r[3] is not None), key=lambda r: (r[3], r[1] if r[1] is not None else -1)):
        ms = round((ts - T0).total_seconds() * 1000) + round(T0.timestamp() * 1000)
        if c in state and (kind == "start" or ms - state[c]["last"] >= calls.SILENCE):
            close(c)
        s = state.setdefault(c, {"start": ms, "chunks": 0, "flag": False, "mean": 0.0, "held": [], "win": []})
        s["last"] = ms
        s["held"] += [0.5 if score is None else score] * (n or 0)
        while len(s["held"]) >= 500:
            s["win"] = [*s["win"], sum(s["held"][:500]) / 500][-4:]
            s["held"] = s["held"][500:]
            m = sum(s["win"]) / len(s["win"])
            s["chunks"] += 1
            s["flag"] |= m >= 0.75
            s["mean"] = 0.85 * s["mean"] + 0.15 * m
        if kind == "end":
            close(c)
    for c in list(state):
        close(c)
    return sorted(out, key=lambda r: r[:2])


def frames(seed, n=150):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 200, 60_000, 900_000])
        kind = rng.choices(["frame", "start", "end", None], [20, 1, 2, 5])[0]
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, kind, T0 + dt.timedelta(milliseconds=at), rng.choice([0, None, 20, 499, 500, 501, 3000]), rng.choice([0.1, 0.9, 0.95, None])))
    return rows


def summary(df):
    return sorted((r.call_id, r.started_ms, r.duration_ms, r.chunks, r.flagged, r.final_score) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batch_twin(spark, seed):
    rows = [*frames(seed), (None, 1, "frame", T0, 100, 0.5), (1, 2, "frame", None, 100, 0.5)]
    assert summary(calls.summaries(spark.createDataFrame(rows, FRAMES))) == loop(rows)
    assert calls.summaries(spark.createDataFrame([], FRAMES)).count() == 0


@pytest.mark.parametrize("cuts", [(), (40,), (13, 14, 90)])
def test_stream_equals_twin_over_any_cut(spark, tmp_path, cuts):
    rows = frames(7)
    edges = [0, *cuts, len(rows)]
    end = max(r[3] for r in rows)
    # rows of another call, far later, move the watermark past every timer
    parts = [rows[a:b] for a, b in zip(edges, edges[1:])] + [[(99, 1, "frame", end + dt.timedelta(hours=h), 10, 0.5)] for h in (5, 20)]
    for part in parts:
        s = stream_of(spark, str(tmp_path / "in"), part, FRAMES)
    drain(calls.sessions(s), tmp_path)
    got = summary(spark.read.parquet(str(tmp_path / "out")).where("call_id < 99"))
    assert got == loop(rows) and any(r[4] for r in got)


def test_batches_complete_once_and_expire(spark, tmp_path, no_idle_batches):
    schema = "batch_id long, total long, status string"
    for part in ([(1, 2, "done"), (2, 3, "done"), (3, 0, None), (None, 1, "done")], [(1, 2, "failed"), (2, 3, "done"), (1, 2, "done")]):
        s = stream_of(spark, str(tmp_path / "in"), part, schema)
    drain(expiring.batch_completion(s), tmp_path)
    read = lambda: sorted((r.batch_id, r.done, r.failed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == [(1, 2, 1), (3, 0, 0)]


def test_an_expired_batch_starts_anew(spark, tmp_path, no_idle_batches):
    schema = "batch_id long, total long, status string"
    state = lambda: spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "progress").load().select("key.batch_id").collect()
    s = stream_of(spark, str(tmp_path / "in"), [(1, 3, "done"), (1, 3, "done")], schema)
    drain(expiring.batch_completion(s, ttl=8), tmp_path)
    assert [r.batch_id for r in state()] == [1]
    time.sleep(9)
    s = stream_of(spark, str(tmp_path / "in"), [(2, 5, "done")], schema)
    drain(expiring.batch_completion(s, ttl=8), tmp_path)
    assert [r.batch_id for r in state()] == [2]  # the first has left the store
    time.sleep(9)
    s = stream_of(spark, str(tmp_path / "in"), [(1, 3, "done")], schema)
    drain(expiring.batch_completion(s, ttl=8), tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # with its first two items it would be complete


def test_cache_by_tier(spark, tmp_path, no_idle_batches):
    schema = "request_id long, content_hash string, tier string, ts timestamp, score double"
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [
        [(1, "a", "anonymous", at(0), 0.1), (2, "a", "pro", at(0.5), 0.2), (3, "b", "pro", at(0), 0.3), (4, "c", "odd", at(0), 0.4)],
        [(5, "a", "pro", at(1), 0.5), (6, "b", "free", at(100), 0.6), (7, "c", "free", at(24), 0.7), (8, None, "free", at(1), 0.8)],
        [(9, "a", "free", at(168.5), 0.9), (10, "b", "free", at(169), 1.0)],
    ]
    for part in parts:
        s = stream_of(spark, str(tmp_path / "in"), part, schema)
    drain(expiring.cached_results(s), tmp_path)
    got = {r.request_id: (r.hit, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (False, 0.1), 2: (True, 0.1), 3: (False, 0.3), 4: (False, 0.4), 5: (False, 0.5), 6: (True, 0.3), 7: (False, 0.7), 9: (True, 0.5), 10: (False, 1.0)}


def test_cache_state_goes_by_the_clock(spark, tmp_path, no_idle_batches):
    schema = "request_id long, content_hash string, tier string, ts timestamp, score double"
    ttl = {"free": 2.0, "pro": 3600.0}
    s = stream_of(spark, str(tmp_path / "in"), [(1, "a", "free", T0, 0.1), (2, "b", "pro", T0, 0.2)], schema)
    drain(expiring.cached_results(s, ttl), tmp_path)
    time.sleep(3)
    s = stream_of(spark, str(tmp_path / "in"), [(3, "a", "free", T0, 0.3), (4, "b", "free", T0, 0.4)], schema)
    drain(expiring.cached_results(s, ttl), tmp_path)
    assert {r.request_id: (r.hit, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: (False, 0.1), 2: (False, 0.2), 3: (False, 0.3), 4: (True, 0.2)}
