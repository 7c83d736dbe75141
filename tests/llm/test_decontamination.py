"""Decontamination against a loop over all windows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contentlens.llm import decontamination, registry
from tests.conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def loop(docs, items, window=10):
    known = defaultdict(set)
    for i, text in items:
        ws = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            known[tuple(ws[k : k + window])].add("" if i is None else str(i))
    out = []
    for d, text in docs:
        ws, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for m in {len(w) for w in known}:
            for k in range(len(ws) - m + 1):
                if (w := tuple(ws[k : k + m])) in known:
                    hit |= set(range(k, k + m))
                    found |= known[w]
        out.append((d, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contaminated(d, i, **how).collect()), key=repr)


def test_whole_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = loop([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = registry.op12_decontamination(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == [(d, n, h, len(i)) for d, n, h, i in sorted(want, key=lambda x: x[0])]
    assert any(r.contaminated for r in got)


@pytest.mark.parametrize("seed, window, shingle, block", [(0, 10, 3, 4096), (1, 4, 2, 5), (2, 3, 3, 1), (3, 5, 1, 7), (4, 1, 3, 2)])
def test_random_texts_few_words(spark, seed, window, shingle, block):
    """Few different words, so that windows overlap, repeat and go over the ends of blocks."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcD") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    items = [(i, text(rng.randrange(window + 4))) for i in range(8)]
    assert run(spark, docs, items, window=window, shingle=shingle, block=block) == loop(docs, items, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(9000))  # over blocks
    passage = "One two THREE four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "... --"), (4, long), (5, passage.upper()), (5, passage.upper()), (None, passage), (6, "é É two"), (7, "short item here"), (8, "x " + passage.replace("five", "5ive"))]
    items = [(1, passage), (1, "short item"), (2, None), (3, ""), (None, "É two"), (4, long.split("w4090 ")[1][:400]), (7, passage), (10, passage)]
    got = run(spark, docs, items)
    assert got == loop(docs, items)
    assert [r for r in got if r[0] == 5] == [(5, 11, 11, ["1", "10", "7"])] * 2  # ids sort as strings


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"a{i} {passage} b{i}" if i % 3 else f"c{i} d") for i in range(300)]
    assert run(spark, docs, [(1, passage), (2, "p3 p4")]) == loop(docs, [(1, passage), (2, "p3 p4")])


def test_empty_tables_and_extra_columns(spark):
    docs, items = [(1, "a b c")], [(1, "a b")]
    assert run(spark, [], items) == [] and run(spark, docs, []) == [(1, 3, 0, [])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "block", "ws", "found", "h", "w", "m", "n_words", "items")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "w", "ws", "o")})
    assert [(r.n_words, r.n_hit) for r in decontamination.contaminated(d, i).collect()] == [(3, 2)]


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST", 6)
    monkeypatch.setattr(decontamination, "MOST", 6)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    docs, items = [(i, text(50)) for i in range(20)], [(i, text(12)) for i in range(30)]
    assert run(spark, docs, items, window=3) == loop(docs, items, 3)


def test_native(spark):
    plan = registry.op12_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
