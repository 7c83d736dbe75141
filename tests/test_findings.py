"""Findings of a review: each test failed before its change."""

import itertools
import math
import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from contentlens.functions import attacks, texts
from contentlens.operators import monitoring, perplexity, shared
from contentlens.plans import registry
from contentlens.plans.base import r6
from contentlens.streaming import calls

SF = "/root/testdata/sf0.001"


def test_series_of_one_length_have_no_correlation(spark, tmp_path):
    rows = [(1, t, "x" * 7) for t in range(5)] + [(2, t, "x" * (3 + t)) for t in range(5)] + [(3, t, None if t != 1 and t != 2 else "ab") for t in range(5)] + [(4, t, "x" * (t % 2)) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.pairs, r.r, r.verdict) for r in registry.QUERIES["series_consistency"](spark, str(tmp_path)).collect()}
    assert got[1][0] == 4 and math.isnan(got[1][1]) and got[1][2] == "consistent"
    assert got[2] == (4, 1.0, "consistent") and got[4] == (5, -1.0, "mismatch") and 3 not in got


def test_mean_score_at_the_threshold(spark, tmp_path):
    """Discounts with a mean of .07 make a score of .7, in whatever order they are added."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(1)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(1)
    made = [(k, v) for k, vs in enumerate(([0.1, 0.08, 0.03], [0.03, 0.08, 0.1], [0.08, 0.1, 0.03], [0.02, 0.1, 0.09], [0.07] * 6, [0.08, 0.09, 0.05, 0.09, 0.04])) for v in vs]
    of = lambda df, values, names: values.crossJoin(df.drop(*names)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])
    of(orders, spark.createDataFrame([(k, 5) for k in range(6)], "o_orderkey long, o_custkey long"), ["o_orderkey", "o_custkey"]).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    of(lines, spark.createDataFrame(made, "l_orderkey long, l_discount double").coalesce(1), ["l_orderkey", "l_discount"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    row = registry.QUERIES["usage_stats"](spark, str(tmp_path)).first()
    assert (row.total, row.n_ai, row.mean_score) == (6, 6, 0.7)


def test_ratios_at_a_tie_round_as_in_sql(spark, tmp_path):
    """323 / 640 = .5046875, which times a million is a little under a half: SQL rounds down."""
    assert spark.range(1).select(r6(F.lit(323) / F.lit(640)), r6("id")).first() == (0.504687, 0.0)
    text = " ".join(f"w{i % 323}" for i in range(640))
    spark.createDataFrame([(7, text, "en", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.QUERIES["layer_vectors"](spark, str(tmp_path)).first().features[16] == 0.504687


def test_few_pairs_leave_the_join_of_bands(spark):
    """Texts of one vocabulary share bands and are not near: their pairs end within the join, where signatures were fetched for each."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, t + " " + words[0]) for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "id long, text string")
    sig = {r.id: r.signature for r in texts.signatures(df, "id", "text").collect()}
    same = {(a, b): sum(x == y for x, y in zip(sig[a], sig[b])) for a, b in itertools.combinations(sorted(sig), 2)}
    both = spark.createDataFrame([(sig[a], sig[b], n) for (a, b), n in list(same.items())[:300]], "a array<long>, b array<long>, n int")
    both = both.select("n", texts.planes(F.col("a"), 100).alias("a"), texts.planes(F.col("b"), 100).alias("b"))
    apart = texts.planes_apart([F.col("a")[i] for i in range(8)], [F.col("b")[i] for i in range(8)])
    assert both.where((apart > 100 - F.col("n")) | (apart < 0.7 * (100 - F.col("n")))).isEmpty()
    out = texts.near_duplicates(df, "id", "text")
    assert {(r.a, r.b): round(100 * r.similarity) for r in out.collect()} == {k: n for k, n in same.items() if n >= 85}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in next(line for line in plan.splitlines() if "Join Inner" in line and "band" in line)


def test_attacks_cut_a_text_once(spark):
    """All attacks of a table cut and draw each kind of parts once, and give what each gives alone."""
    rows = [(1, "The cat is big. It was good, a code of peace. Make it small."), (2, None), (3, ""), (4, "x"), (5, "é\U0001f44d a\nb. c"), (6, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = attacks.attacked(df)
    alone = df.select("id", *[attacks.ATTACKS[k](F.col("text"), v).alias(f"{k} {s}") for k, by in attacks.STRENGTHS.items() for s, v in by.items()])
    want = {(r.id, k): r[k] for r in alone.collect() for k in alone.columns[1:]}
    assert {(r.id, f"{r.attack} {r.strength}"): r.text for r in out.collect()} == want and len(want) == 72 and want[2, "shuffle low"] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 3


def test_perplexity_leaves_no_steps_on_the_disk(spark):
    """What a written step shuffled goes with it, and of the perplexities' tables at most the last three are left: all were kept before."""
    local = [Path(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {f.name for p in local for f in p.rglob("shuffle_*.data")}
    before = shuffled()
    out = shared.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # executors take them away in the background
        if left := shuffled() - before:
            time.sleep(0.2)
    assert not left and out.count() == 7
    shared.dropped(out)
    where = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(where.iterdir())
    df = spark.createDataFrame([(i, f"The cat sat on the mat. The dog number {i} sat on the log.") for i in range(9)], "id long, text string")
    assert perplexity.perplexity(df).where("ppl_sentences = 2").count() == 9
    assert len(set(where.iterdir()) - before) <= 3


def test_words_of_one_id_get_another_seed(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"The cat sat on the mat. The dog number {i} sat on the log.") for i in range(9)], "id long, text string")
    rows = lambda: sorted((r.id, round(r.ppl_mean, 9), round(r.ppl_std, 9)) for r in perplexity.perplexity(df).collect())
    want, real = rows(), perplexity.word_id
    monkeypatch.setattr(perplexity, "word_id", lambda w, seed: F.pmod(real(w, seed), F.lit(3).cast("long")) if seed < 2 else real(w, seed))
    assert rows() == want


def test_each_text_is_cut_once_for_its_shingles(spark):
    """An inner explode of an expression has a filter before it that evaluates it again."""
    df = spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, ""), (4, None)], "id long, text string")
    plan = texts.signatures(df, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    cuts = [line for line in plan.splitlines() if "Generate explode" in line and "regexp_extract_all" in line and "[shingle" in line]
    assert any(", true, [shingle" in line for line in cuts)
    assert {r.id for r in texts.signatures(df, "id", "text").collect()} == {1, 2, 3}


def test_one_sketch_brackets_all_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    out = monitoring.nearest_rank(df, ["g"], "v", {"a": 0.5, "b": 0.95, "c": 0.99})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("percentile_approx") for line in plan.splitlines()) == 1
    rows = {g: sorted(r.v for r in df.where(f"g = {g}").collect()) for g in (0, 1)}
    assert {r.g: (r.a, r.b, r.c) for r in out.collect()} == {g: tuple(vs[round(q * (len(vs) - 1))] for q in (0.5, 0.95, 0.99)) for g, vs in rows.items()}


def test_summaries_of_calls_sort_twice_in_tasks_of_one_size(spark, monkeypatch):
    """A task has two sorts and no hash tables, and a larger table has more tasks, not larger ones."""
    monkeypatch.setattr(calls, "PARTS", 1000, raising=False)
    frames = lambda n: spark.range(n).selectExpr("id % 40 call_id", "id seq", "'frame' kind", "timestamp_seconds(id) ts", "2600L len", "0.5D score")
    df = calls.summaries(frames(6000))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 2 and "Aggregate" not in plan and "Join" not in plan
    assert [calls.summaries(frames(n)).rdd.getNumPartitions() for n in (60, 6000, 12000)] == [4, 38, 75]
    assert {(r.chunks, r.duration_ms, r.flagged) for r in df.collect()} == {(780, 149 * 40_000, False)} and df.count() == 40


def test_calls_with_frames_below_no_length(spark):
    """As in the stream, such frames count for the times only, also as the last of a call."""
    rows = [(1, 0, 0, 500, 0.9), (1, 1, 1, -300, 0.1), (1, 2, 2, 500, 0.9), (1, 3, 3, -1, 0.0), (2, 0, 5, -7, 1.0)]
    frames = spark.createDataFrame(rows, "call_id long, seq long, at long, len long, score double").selectExpr("call_id", "seq", "'frame' kind", "timestamp_seconds(at) ts", "len", "score")
    got = sorted((r.call_id, r.started_ms, r.duration_ms, r.chunks, r.flagged, round(r.final_score, 12)) for r in calls.summaries(frames).collect())
    assert got == [(1, 0, 3000, 2, True, 0.24975), (2, 5000, 0, 0, False, 0.0)]


def test_percentiles_of_a_whole_table_join_one_row(spark):
    """A constant key is folded away and leaves a join without one, of sides that look large."""
    plan = registry.QUERIES["reference_distribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(9001)).cast("double").alias("v"))
    out = monitoring.linear_percentiles(df, [], "v", {"a": 0.5, "b": 0.95})
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    vs = sorted(r.v for r in df.collect())
    at = lambda q: vs[math.floor(q * 39_999)] * (1 - q * 39_999 % 1) + vs[math.ceil(q * 39_999)] * (q * 39_999 % 1)
    assert all(math.isclose(x, at(q), abs_tol=1e-6) for x, q in zip(out.first(), (0.5, 0.95)))
    few = lambda vs: monitoring.linear_percentiles(spark.createDataFrame([(v,) for v in vs], "v double"), [], "v", {"a": 0.5}).first().a
    assert few([None, 1.0, 4.0]) == 2.5 and few([3.0]) == 3.0 and few([None]) is None


def test_near_pairs_meet_by_two_bands_and_leave_the_join_once(spark, monkeypatch):
    """Any number of bands, blocks of a large key and places over the edge of a long give what all pairs give; no pair was told from its copies or verified after a second join."""
    monkeypatch.setattr(texts, "BLOCK", 7, raising=False)
    monkeypatch.setattr(texts, "TESTS", 500, raising=False)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(6)]
    rows = [(f"{i}", f"{t} {' '.join(rng.sample(words, i % 9))}") for i, t in enumerate(base * 12)]
    df = spark.createDataFrame(rows, "id string, text string")
    for bands, per_band, least in ((20, 5, 0.85), (15, 7, 0.9), (4, 25, 0.6), (10, 2, 1.0)):
        seeds = bands * per_band
        first = {}
        for r in texts.signatures(df, "id", "text", seeds).collect():
            first[tuple(r.signature)] = min(r.id, first.get(tuple(r.signature), r.id))
        want = {}
        for (s, i), (t, j) in itertools.combinations(first.items(), 2):
            same = sum(p == q for p, q in zip(s, t))
            if same / seeds >= least and any(s[b : b + per_band] == t[b : b + per_band] for b in range(0, seeds, per_band)):
                want[min(i, j), max(i, j)] = same / seeds
        out = texts.near_duplicates(df, "id", "text", bands, per_band, least)
        got = [((r.a, r.b), r.similarity) for r in out.collect() if r.similarity < 1]
        assert dict(got) == want and len(got) == len(want)
        assert bool(want) == (least < 1)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [a#") == 1 and "zip_with" not in plan and plan.count("Join Inner") == 4
    # whatever 15 of 100 places are, two of some key's bands are free of them
    keys = texts._band_keys(20, 15)
    assert len(keys) == 40 and all(any(not set(k) & set(bad) for k in keys) for bad in (rng.sample(range(20), 15) for _ in range(2000)))


def test_attacks_of_all_strengths_share_their_segments(spark, monkeypatch):
    """Places are drawn and sorted once for each kind of parts, not for each strength; a bound that lets too few through changes nothing."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc e.\né") for _ in range(n))) for i, n in enumerate((1, 2, 9, 40, 700, 30_000))]
    df = spark.createDataFrame(rows, "id long, text string")

    def spoiled(text, per_cent, least, change):
        m = len(text)
        drawn = sorted(range(m), key=lambda i: (i + m) * attacks.TIMES % attacks.MODULUS)
        places = set(drawn[: max(least, m * per_cent // 100)])
        return "".join(change(c) if i in places else c for i, c in enumerate(text))

    change = {"zwsp": (0, lambda c: attacks.BLANK + c), "homoglyph": (1, lambda c: attacks.GLYPHS.get(c, c))}
    want = {(i, k, s): spoiled(text, v, *change[k]) for i, text in rows for k in change for s, v in attacks.STRENGTHS[k].items()}
    for slack in (16, -100_000):
        monkeypatch.setattr(attacks, "_SLACK", slack, raising=False)
        out = attacks.attacked(df)
        assert {(r.id, r.attack, r.strength): r.text for r in out.collect() if r.attack in change} == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 6


def test_perplexity_counts_a_large_table_in_slices(spark, monkeypatch):
    """No step reads or shuffles the words of all texts, whose perplexities stay the same."""
    df = spark.createDataFrame([(i, f"The cat sat on the mat. The dog number {i} sat on the log.") for i in range(9)], "id long, text string")
    rows = lambda: sorted((r.id, r.ppl_sentences, round(r.ppl_mean, 9), round(r.ppl_std, 9)) for r in perplexity.perplexity(df).collect())
    want, real, seen = rows(), perplexity.fitted, []
    monkeypatch.setattr(perplexity, "SLICE", 50, raising=False)
    monkeypatch.setattr(perplexity, "SLICES", 4, raising=False)
    monkeypatch.setattr(perplexity, "fitted", lambda by_text, *rest: (seen.append(by_text.count()), real(by_text, *rest))[1])
    where = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(where.rglob("*.parquet"))
    assert rows() == want
    assert len(seen) == 3 and sum(seen) == 9 * 14 and max(seen) < 9 * 14
    # what is left: perplexities by slice, and those of texts
    assert len({p.parent for p in set(where.rglob("*.parquet")) - before}) <= 4
