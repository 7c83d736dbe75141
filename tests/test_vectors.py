"""Full feature vectors: defaults, layers and detectors that failed, odd texts."""

import math

import pytest
from pyspark.sql import functions as F

from contentlens.functions import vectors as v
from contentlens.functions.decisions import metadata_adjusted
from contentlens.functions.evidence import agent_risk, agent_signs

OUT = "array<struct<type:string,score:double,confidence:double,error:boolean,flagged:array<double>>>"


def layers(spark, rows):
    df = spark.createDataFrame(rows, "text string, a double, b double, c double, d double, ppl double, mean double, commas double")
    scores = dict(zip(v.LAYERS, (F.col(x) for x in "abcd")))
    return [r[0] for r in df.select(v.layer_vector(scores, {"mean_perplexity": F.col("ppl"), "sent_len_mean": F.col("mean"), "comma_rate": F.col("commas")}, F.col("text"))).collect()]


def test_layer_vector(spark):
    text = "One two three four. Five six. Seven eight nine ten eleven"
    full, failed, empty = layers(spark, [(text, 0.2, 0.4, 0.6, 0.8, 50.0, 7.0, 0.2), (text, None, None, None, 0.8, 50.0, None, 0.2), (None, None, None, None, None, None, None, None)])
    assert all(len(x) == 26 for x in (full, failed, empty))
    assert full[:12] == [0.2, 0.4, 0.6, 0.8, 1, 1, 1, 1, 50, 30, 30, 0.3] and full[12:14] == [7, 5] and full[18] == 0.2
    assert full[22:25] == [11, 2, 5.5] and full[25] == pytest.approx(math.sqrt(0.05))
    # a layer that failed gives defaults, whatever evidence is there, and one score has no spread
    assert failed[:9] == [0.5, 0.5, 0.5, 0.8, 0, 0, 0, 1, 80] and failed[12] == 5.5 and failed[18] == 0.05 and failed[25] == 0
    assert empty[:8] == [0.5] * 4 + [0] * 4 and empty[12:14] == [0, 5] and empty[22:] == [0, 1, 0, 0]


def test_layer_vector_without_columns(spark):
    assert len(spark.range(1).select(v.layer_vector({}, {}, F.lit("a")).alias("x")).first().x) == 26


def test_detector_vector(spark):
    rows = [
        ([("video", 0.9, 0.7, False, [0.6, 0.8]), ("text", 0.3, 0.5, None, None), ("image", 0.1, 0.9, True, [0.95])], True),
        ([("text", 0.3, 0.5, False, []), ("text", 0.4, 0.6, False, [])], None), ([], False), (None, None),
        ([("hologram", 0.9, 0.9, False, [0.2])], False), ([("audio", None, None, False, None)], False), ([(x, 0.9, 0.9, True, None) for x in v.DETECTORS], False),
    ]
    df = spark.createDataFrame(rows, f"o {OUT}, w boolean")
    got = [r[0] for r in df.select(v.detector_vector(F.col("o"), F.col("w"), F.lit(None).cast("boolean"), F.lit(True))).collect()]
    assert all(len(x) == 29 for x in got)
    mixed, twice, empty, null, strange, silent, broken = got
    assert mixed[:15] == [0.3, 0.5, 0.9, 0.5, 0.5, 0.5, 0, 0.7, 0, 0, 0, 1, 0, 0, 0]
    worked = [0.3, 0.9, 0.5, 0.5]
    mean = sum(worked) / 4
    assert mixed[15:19] == pytest.approx([mean, 0.9, 0.3, math.sqrt(sum((x - mean) ** 2 for x in worked) / 4)])
    assert mixed[19:] == [1, 0, 1, 0, 0, 1, 0, 0, 3, 0.95]
    assert twice[0] == 0.4 and twice[5] == 0.6 and twice[19] == 0
    assert empty[22:] == [1, 0, 0, 0, 0, 0, 0] and null[15:19] == [0.5, 0.5, 0.5, 0] and null[19] == 0
    assert strange[:5] == [0.5] * 5 and strange[22:] == [1, 0, 0, 0, 0, 1, 0.2]
    assert silent[3] == 0.5 and silent[8] == 0 and silent[25] == 1
    assert broken[15:19] == [0.5, 0.5, 0.5, 0] and broken[10:15] == [1] * 5


def test_metadata_adjusted(spark):
    rows = [(0.5, 0.8, True, True, False, True, 5), (0.5, 0.7, True, True, True, False, 1), (0.95, 1.0, True, False, False, True, 9), (None, 0.9, True, True, True, True, 1), (0.1, None, None, None, True, None, None)]
    df = spark.createDataFrame(rows, "s double, w double, ai boolean, cam boolean, ok boolean, img boolean, n int")
    signs = {"watermark": F.col("w"), "ai_device": F.col("ai"), "camera": F.col("cam"), "verified": F.col("ok"), "image": F.col("img"), "suspicious": F.col("n")}
    got = [tuple(r) for r in df.select(*[metadata_adjusted(F.col("s"), k, **signs) for k in ("engine", "result")]).collect()]
    want = [(0.5 + 0.08 + 0.06 - 0.04, 0.5 + 0.12 + 0.08), (0.5 + 0.06 - 0.04 - 0.15, 0.5 - 0.05 - 0.2), (0.99, 0.99), (None, None), (0.01, 0.01)]
    assert [x is None for r in got for x in r] == [x is None for r in want for x in r]
    assert [x for r in got for x in r if x is not None] == pytest.approx([x for r in want for x in r if x is not None])


def test_agent_signs(spark):
    rows = [
        (0.1, "My-Crawler/1", 2999, 4, False, False, 1001), (0.15, "Mozilla", 3000, 9, True, True, 9999), (None, None, None, None, None, None, None),
        (0.2, "curl/8", 100, 3, True, False, 1000), (0.2, "GO-HTTP", 100, 4, True, None, 10),
    ]
    df = spark.createDataFrame(rows, "cv double, ua string, ms long, n long, mouse boolean, scroll boolean, h long")
    df = df.select(agent_signs(*[F.col(c) for c in df.columns]).alias("s"))
    got = [(r.s, r.a, round(r.c, 4), r.r) for r in df.select("s", *[c.alias(n) for c, n in zip(agent_risk(F.col("s")), "acr")]).collect()]
    assert got[0] == (["keystrokes", "user_agent", "fast_form", "no_mouse", "no_scroll"], True, 1.0, "high")
    assert got[1:4] == [([], False, 0.0, "low"), (["no_mouse"], False, 0.3333, "low"), (["user_agent"], False, 0.3333, "low")]
    assert got[4] == (["user_agent", "fast_form"], True, 0.6667, "medium")
