"""The pipeline end to end, stage by stage against what each stage must keep."""

import collections
import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from contentlens.llm import mixing, pieces, registry
from contentlens.llm.common import WORD, materialise
from tests.llm.test_operators import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "tokenize":
            assert docs.columns == columns
    n = {k: d.count() for k, d in seen.items()}
    assert n["quality_filter"] == n["line_dedup"] >= n["near_dedup"] > 0
    kept = {r.doc_id for r in seen["near_dedup"].select("doc_id").collect()}
    assert len(kept) == n["near_dedup"]
    assert {r.doc_id for r in seen["mix_sources"].select("doc_id").collect()} <= kept
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = seen["tokenize"].collect()
    assert all(r.ids == sp.encode(r.text) for r in rows) and len(rows) == n["mix_sources"]


def test_run_equals_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = lambda d: sorted((r.doc_id, r.text, r.source, list(r.ids)) for r in d.collect())
    want = rows(docs)
    assert want and rows(corpus_pipeline.run(spark, SF)) == want


def test_stages_against_plain_computation(spark):
    """Each stage on all documents, against what its operator's definition gives in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in registry.op2_quality_classifier(spark, SF).collect()}
    assert sorted(r.doc_id for r in stages["quality_filter"](spark, docs, SF).collect()) == sorted(i for i, p in scores.items() if p)
    sites, first = collections.defaultdict(set), {}
    for i, r in text.items():
        for k, line in enumerate(r.text.split("\n")):
            if line.strip(" "):
                sites[line].add(r.source)
                first[line] = min(first.get(line, (i, k)), (i, k))
    want = {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if len(sites[x]) < 5 or first[x] == (i, k)) for i, r in text.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    classes = brute_classes({i: brute_fingerprint(r.text) for i, r in text.items()})
    kept = stages["near_dedup"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(classes.values())) and all(r == text[r.doc_id] for r in kept)
    taken, words = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}, collections.Counter()
    for r in stages["mix_sources"](spark, docs, SF).collect():
        words[r.doc_id] += len(re.findall(WORD, r.text))
        own = re.findall(WORD, text[r.doc_id].text)
        assert r.source == text[r.doc_id].source and r.n_chars == len(r.text) and not collections.Counter(re.findall(WORD, r.text)) - collections.Counter(own)
    assert words == {i: n for i, n in taken.items() if n}


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "x", 5), (2, "", "en", "x", 0), (2, "", "en", "x", 0), (3, "words " * 400, "en", None, 2400)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    full = full.withColumns({c: F.lit("mine") for c in ("score", "predicted", "n_removed", "ids", "fp", "__row", "taken")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (full, full.limit(0)):
        docs, empty, seen = docs, docs.count() == 0, {}
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)))
            seen[name] = docs.collect()
            assert docs.columns == full.columns + (["ids_"] if name == "tokenize" else [])
            assert all(r[c] == "mine" for r in seen[name] for c in ("score", "predicted", "n_removed", "ids", "fp", "__row", "taken"))
        ids = {k: sorted((r.doc_id is None, r.doc_id) for r in v) for k, v in seen.items()}
        if empty:
            assert not any(ids.values())
        else:  # nothing is labelled, so nothing is rejected; null and empty texts are one class, which has no words to take
            assert ids["quality_filter"] == ids["line_dedup"] == [(False, 1), (False, 2), (False, 2), (False, 3), (True, None)]
            assert ids["near_dedup"] == [(False, 1), (False, 3), (True, None)]
            assert set(ids["mix_sources"]) <= {(False, 3), (True, None)} and ids["tokenize"] == ids["mix_sources"]
