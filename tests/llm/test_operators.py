"""Operators held against brute force on small fixtures, and their defined edge cases."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contentlens.llm import fingerprints, language, lines, mixing, neighbours, pieces, quality, registry, secret_scan, sharding, simhash
from contentlens.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five", "en", "a"), (1, "one two three four five", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no id here at all", "fr", "b"),
        (None, None, None, None), (4, "   \n\t ", "de", "b"), (5, long, "en", None), (6, "x", None, "c"), (7, "one two three four five", "en", "c"), (8, "ünï cødé 漢字 🎉 text", "en", "a"),
    ]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# --- line dedup


def test_lines_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["common", "rare %d" % rng.randint(0, 400), "mid %d" % rng.randint(0, 9), ""]) for _ in range(8)), "en", f"s{i % 9}") for i in range(120)]
    seen = collections.defaultdict(set)
    first = {}
    for i, t, _, s in rows:
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                seen[line].add(s)
                first[line] = min(first.get(line, (i, k)), (i, k))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not (len(seen[x]) >= 5 and first[x] != (i, k))) for i, t, *_ in rows}
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == want


def test_lines_odd(spark, odd, empty):
    out = lines.dedup_lines(odd.withColumn("n_removed", F.lit("mine")), min_sites=1).collect()
    assert len(out) == odd.count()
    assert sum(r.text == "one two three four five" for r in out) == 2  # both copies of row 1; row 7 loses the line
    assert [r.text for r in out if r.doc_id == 2] == [None]
    assert lines.dedup_lines(empty).count() == 0


# --- quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = registry.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([r.predicted == 1 for r in out if r.quality == 1]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_machine_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    at, x = np.array([1, 5, 9]), np.array([0.5, -1.0, 2.0])
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    z = 0.1 + float(m.linear[at] @ x) + pairs
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_features_are_summed_by_place():
    words = [f"w{i}" for i in range(3000)]
    places = collections.defaultdict(list)
    for w in words:
        places[zlib.crc32(w.encode()) % quality.BUCKETS].append(w)
    a, b = next(v for v in places.values() if len(v) > 1)[:2]
    at, x = quality.features(f"{a} {b} {b} other", None)
    assert len(set(at.tolist())) == len(at) and (x[at < quality.BUCKETS] ** 2).sum() == pytest.approx(1)


def test_quality_query_brute_force(spark):
    """The query's scores, by a double loop over pairs of features of the fitted machine."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))
    out = {r.doc_id: r for r in registry.op2_quality_classifier(spark, SF).collect()}
    for r in d.orderBy(F.length("text")).limit(25).collect():
        at, x = quality.features(r.text, r.n_chars)
        z = m.bias + sum(m.linear[i] * v for i, v in zip(at, x))
        z += sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert out[r.doc_id].score == pytest.approx(score, abs=1e-9) and out[r.doc_id].predicted == int(score >= 0.3)
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_documents(odd.withColumn("score", F.lit("x")), none).collect()
    assert len(out) == odd.count() and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(odd, some).count() == odd.count()
    assert quality.score_documents(empty, some).count() == 0


# --- language


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = registry.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_mixture(spark, real):
    model = language.fit(real)
    by = {lang: " ".join(r.text for r in real.where(F.col("lang") == lang).limit(8).collect()) for lang in ("en", "fr")}
    half = by["en"][:6000] + " " + by["fr"][:3000]
    share = language.mixture(*language.word_likelihoods([half, by["en"], ""], model[1]))
    names = model[0]
    assert 0.5 < share[0][names.index("en")] < 0.85 and 0.15 < share[0][names.index("fr")] < 0.5
    assert share[1][names.index("en")] > 0.9 and share[2].sum() == 0


def test_language_brute_force(spark, real):
    """EM and the choice of languages, by loops over words."""
    names, logp = language.fit(real)
    texts = [r.text[:600] for r in real.orderBy("doc_id").limit(12).collect()]
    texts += [texts[0][:200] + " " + texts[5][:200], "a", ""]
    got = language.mixture(*language.word_likelihoods(texts, logp))

    def em(words, allowed):
        pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(names))]
        for _ in range(language.ROUNDS):
            sums = [0.0] * len(names)
            for w in words:
                r = [p * x for p, x in zip(pi, w)]
                for k in range(len(names)):
                    sums[k] += r[k] / sum(r)
            pi = [x / len(words) for x in sums]
        return pi, sum(np.log(sum(p * x for p, x in zip(pi, w)) + 1e-300) for w in words)

    for t, share in zip(texts, got):
        ll, many = language.word_likelihoods([t], logp)
        assert many[0] == len(re.findall(r"[^\W\d_]+", t)) or not t.isascii()
        if not many[0]:
            assert share.sum() == 0
            continue
        words = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60)).astype(float).tolist()
        allowed = list(range(len(names)))
        pi, fit = em(words, allowed)
        while len(allowed) > 1:
            fewer = [k for k in allowed if k != min(allowed, key=lambda k: pi[k])]
            less_pi, less = em(words, fewer)
            if fit - less >= language.PENALTY * np.log(many[0] + 1.0):
                break
            allowed, pi, fit = fewer, less_pi, less
        assert share == pytest.approx(pi, abs=1e-4)


def test_language_learns_every_language(spark):
    """More languages than there once was room for."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(900)]
    rows = [(10 * k + j, " ".join("".join(rng.choice(letters[3 * k : 3 * k + 3]) for _ in range(3)) for _ in range(5)), f"l{k:03}", "s") for k in range(230) for j in range(3)]
    out = language.predict(docs(spark, rows)).collect()
    assert len({r.lang_pred for r in out}) == 230 and np.mean([r.lang == r.lang_pred for r in out]) > 0.99


def test_language_odd(spark, odd, empty):
    out = {(r.doc_id, r.text): r for r in language.predict(odd.withColumn("lang_pred", F.lit(1))).collect()}
    assert out[2, None].lang_pred == "und" and out[2, None].lang_score == 0
    assert out[4, "   \n\t "].lang_pred == "und"
    assert language.predict(empty).count() == 0
    assert language.predict(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


# --- pieces


def test_pieces_equal_the_library(real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    rng = random.Random(5)
    texts = [r.text for r in real.collect()]
    texts += ["", " ", "a" * 3000, "ab" * 2000, "aaaa b", "\x00\n\n\t x", "  two  spaces  ", "日本語🎉�é́"]
    texts += ["".join(rng.choice("theinrsoa") for _ in range(400)) for _ in range(30)] + ["".join(rng.choice("aé \n漢🎉.,xT") for _ in range(80)) for _ in range(60)]
    for t in texts:
        ids = p.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert p.decode(ids) == t


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def test_pieces_commit_early(real, vocabulary, monkeypatch):
    """Ordinary text, given whole and without the memo, is committed in many small runs from a window that stays small."""
    import sentencepiece

    p, sp = vocabulary, sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    held, window = [], p._window
    monkeypatch.setattr(p, "_window", lambda parts, *a: held.append(max(map(len, parts))) or window(parts, *a))
    texts = ["theinrsoa" * 200, *[r.text for r in real.orderBy("doc_id").limit(12).collect()]]
    runs = collections.defaultdict(list)
    for k, ids in p.walk([(" " + t).replace(" ", pieces.MARK) for t in texts]):
        runs[k].append(np.frombuffer(ids, np.int32))
    for k, t in enumerate(texts):
        assert np.concatenate(runs[k]).tolist() == sp.encode(t)
        assert max(map(len, runs[k])) <= 4 * p.longest and len(runs[k]) > len(t) / (8 * p.longest)
    assert max(held) <= 4 * p.longest


def test_pieces_window_doubles_where_paths_part(vocabulary, monkeypatch):
    import sentencepiece

    meet, seen = vocabulary._meet, []
    monkeypatch.setattr(vocabulary, "_meet", lambda come, size: seen.append(size) or (meet(come, size) if size >= 16 * vocabulary.longest else 0))
    text = "theinrsoa" * 120
    got = np.frombuffer(b"".join(ids for _, ids in vocabulary.walk([pieces.MARK + text])), np.int32)
    assert got.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert {4 * vocabulary.longest, 8 * vocabulary.longest, 16 * vocabulary.longest} <= set(seen)


def test_stable_pairs_brute_force(vocabulary):
    """The merge rules run on both pieces at once."""
    p, rng = vocabulary, random.Random(2)
    ids = [i for t, i in p.id.items() if len(t) < 6]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(p.id[t[:k]], p.id[t[k:]]) for t in list(p.id)[3000:4000] for k in range(1, len(t)) if t[:k] in p.id and t[k:] in p.id]

    def merged(text):
        s = list(text)
        while True:
            best = min(((p.rank[a + b], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a + b in p.rank), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]

    got = p.stays(*np.array(pairs, np.int64).T)
    assert got.tolist() == [merged(p.text[a] + p.text[b]) == [p.text[a], p.text[b]] for a, b in pairs]


def test_pieces_odd(spark, odd, empty, monkeypatch):
    out = pieces.decode(pieces.encode(odd)).collect()
    assert all(r.decoded == r.text for r in out) and [r.ids for r in out if r.doc_id == 3] == [[]]
    assert pieces.encode(empty).count() == 0
    named = pieces.encode(odd.withColumn("ids", F.lit("mine")).withColumn("__joined", F.lit(1)), out="pieces")
    assert {r.ids for r in named.collect()} == {"mine"} and pieces.decode(named, ids="pieces").where("not decoded <=> text or __joined <> 1").count() == 0
    few = spark.createDataFrame([([5, 10**6, -1],), (None,)], "ids array<int>")
    assert pieces.decode(few).where("ids is null and decoded is not null").count() == 0


def test_pieces_over_run_ends(vocabulary, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    monkeypatch.setattr(pieces, "RUN", 37)
    monkeypatch.setattr(pieces, "MEMO", 5)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeiou  \nxyz漢🎉.▁") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    assert [x.tolist() for x in vocabulary.encode_all(texts)] == [sp.encode(t) for t in texts]
    monkeypatch.setattr(vocabulary, "cuts", False)
    assert [x.tolist() for x in vocabulary.encode_all(texts)] == [sp.encode(t) for t in texts]


# --- SimHash


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_simhash_brute_force(spark, real):
    rows = {r.doc_id: r for r in registry.op5_simhash_near_dedup(spark, SF).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in real.collect()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_classes(fps)


def test_vantage_points_lose_no_link(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "LEAF", 16)
    fps = {}
    for i in range(500):
        f = rng.getrandbits(64)
        fps[len(fps)] = f
        for _ in range(rng.randint(0, 2)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps[len(fps)] = f
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in set(fps.values())], "fp long")
    monkeypatch.setattr(simhash, "FITTED", 2)  # most levels are beyond the fitted ones
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute_classes(fps)
    groups = collections.defaultdict(set)
    for i, f in fps.items():
        groups[want[i]].add(roots.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_odd(spark, odd, empty):
    out = simhash.classes(odd).collect()
    assert len(out) == odd.count()
    assert {r.component_id for r in out if r.doc_id in (1, 7)} == {1}
    assert {r.component_id for r in out if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 8]
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    # nameless rows never keep or lose a named one; one row of a nameless class stays
    many = " ".join(f"v{i}" for i in range(400))
    rows = [(None, many, "en", "a"), (None, many.upper(), "en", "b"), (None, "other words are here", "en", "a"), (9, "other words are here", "en", "b"), (9, many[::-1], "en", "c")]
    kept = simhash.keep_one(docs(spark, rows)).collect()
    by = collections.Counter(r.doc_id for r in kept)
    assert by == {None: 1, 9: 2} and {r.text for r in kept if r.doc_id == 9} == {"other words are here", many[::-1]}
    texts = simhash.classes(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    assert {r.component_id for r in texts if r.doc_id in ("1", "7")} == {"1"}


# --- nearest neighbours


def test_neighbours_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in v.collect()}
    got = collections.defaultdict(list)
    for r in registry.op6_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        best = sorted(((-float(np.cumsum(rows[q] * x)[-1]), i) for i, x in rows.items() if i != q))[:20]
        assert [(i, -s) for s, i in best] == found


def nearest(rows, is_query, k):
    """Brute force in exact fractions, so that no magnitude can go wrong."""
    out = {}
    for q, v in rows:
        if is_query(q):
            got = []
            for c, w in rows:
                if c != q and len(v) == len(w):
                    top = sum(Fraction(x) * Fraction(y) for x, y in zip(v, w))
                    got.append((-top, c))
            out[q] = [c for _, c in sorted(got)[:k]]
    return out


@pytest.mark.parametrize("dim,low,high", [(8, -200, 200), (8, 195, 200), (8, -210, -195), (3, 300, 307), (2300, -3, 3), (9, 0, 0)])
def test_neighbours_of_any_size(spark, monkeypatch, dim, low, high):
    """Several blocks of queries and candidates, several strips; magnitudes apart by hundreds of digits."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "STRIP", 5)
    monkeypatch.setattr(neighbours, "PAIRS", 64)
    rng = np.random.default_rng(dim + high + 1000)
    sizes = [10.0 ** rng.integers(low, high + 1) for _ in range(70)]
    rows = [(i, (rng.normal(size=dim) * s).tolist()) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 6 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = nearest(rows, lambda i: i % 6 == 0, 7)
    assert {q: len(g) for q, g in got.items()} == {q: 7 for q in want}
    for q, best in want.items():
        scores = dict(got[q])
        if all(0 < abs(s) < float("inf") for s in scores.values()):
            assert [i for i, _ in got[q]] == best
        else:  # beyond double precision: infinite or zero ones tie, the smaller id first
            assert [x for _, x in got[q]] == sorted(scores.values(), reverse=True)
            assert all((s, -i) > (t, -j) for (i, s), (j, t) in zip(got[q], got[q][1:]))


def test_neighbours_ties_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    out = neighbours.search(df, F.col("vec_id") % 20 == 0, 9).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        own = [-((i % 3) * (q % 3) + 1) for i in range(60)]
        want = sorted((own[i], i) for i in range(60) if i != q)[:9]
        assert [(r.vec_id, -r.score) for r in out if r.query_id == q] == [(i, s) for s, i in want]


def test_neighbours_odd(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


# --- secrets


def brute_spans(text):
    a = [("assign", m.start(), m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A) if len(m[2]) >= 8]
    k = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    h = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(a + k + h, key=lambda s: (s[1], order.index(s[0])))


def test_secrets_brute_force(spark, real):
    extra = ["é Password = 'abcdefgh1'", 'API_KEY":"zzzzzzzz"', "apikey:short", "AKIA" + "A" * 16, "f" * 32 + " " + "e" * 31, "toKen==abcdefgh", "ſecret=abcdefghij", "passwd: secret=longvalue99", "ghp_" + "aZ" * 18, "TOKEN \t=x"]
    d = real.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in secret_scan.scan(d).collect():
        base = [(x.kind, x.start, x.end) for x in r.found if x.kind in ("assign", "access", "hex")]
        assert base == brute_spans(r.text), r.text
    assert [x.kind for x in secret_scan.scan(d.where("doc_id = 10008")).first().found] == ["github"]


def test_secret_query_brute_force(spark, real, tmp_path):
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 20
    extra = ["é password: 'abcdefgh1' " + "f" * 40, "AKIA" + "A" * 20 + " secret=0123456789abcdef0123456789abcdef", "x " + jwt, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab ghp_" + "Z" * 36, None, "", "_" + jwt]
    real.unionByName(docs(spark, [(10_000 + i, t, "en", "s") for i, t in enumerate(extra)])).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in registry.op7_secret_scan(spark, str(tmp_path)).collect()}
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        base = brute_spans(r.text or "")
        got = out[r.doc_id]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in got.spans.split(",")] if got.spans else []
        assert [(k, int(s), int(e)) for k, s, e in spans if k in ("assign", "access", "hex")] == base and [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)
    kinds = lambda i: {x.split(":")[0] for x in out[10_000 + i].spans.split(",")}
    assert "jwt" in kinds(2) and "pem" in kinds(3) and {"slack", "github"} <= kinds(4) and out[10_006].spans == "" and kinds(7) == {""}


def test_secret_rules_are_linear():
    import time

    for rule in secret_scan.RULES:
        for text in ("eyJ" * 200_000, "password" * 70_000, "AKIA" * 100_000, "xoxb-" * 100_000, "-----BEGIN " * 50_000, "secret" + " " * 300_000):
            began = time.process_time()
            secret_scan.find(rule, text)
            assert time.process_time() - began < 5, (rule.kind, text[:12])


def test_trigram_queries():
    by = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert by["hex"] == [] and by["access"] == [{"aki", "kia"}]
    assert {"tok", "oke", "ken"} in by["assign"] and len(by["assign"]) == 6


def test_secrets_odd(spark, odd, empty):
    out = secret_scan.scan(odd.withColumn("found", F.lit(1))).collect()
    assert len(out) == odd.count() and all(r.found == [] for r in out)
    assert secret_scan.scan(empty).count() == 0


# --- fingerprints


def test_order_minhash_edits(spark, real):
    text = {r.doc_id: r.text for r in real.collect()}
    ids = sorted(text, reverse=True)
    out = {r.doc_id: r for r in registry.op8_order_minhash(spark, SF).collect()}
    for k, n in zip(ids, ids[1:] + ids[:1]):
        half = len(text[k]) // 2
        edited = text[k][: len(text[k]) - half] + text[n][:half]
        assert out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[k].n_chars == len(text[k])
    assert np.mean([r.near_edited > r.near_next for r in out.values()]) > 0.97
    same = collections.defaultdict(set)
    for k in ids:
        same[text[k]].add(out[k].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def brute_signature(text):
    """{bin: texts of the selected k-mers in text order}: as the operator selects, from plain lists; and how many bits of a hash order k-mers."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def longs(*xs):  # Spark's xxhash64 of several longs
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
        return signed(h)

    def mixed(h, i):  # of a long and an int
        return signed(xxhash.xxh64_intdigest(int(i).to_bytes(4, "little", signed=True), xxhash.xxh64_intdigest(int(h).to_bytes(8, "little", signed=True), 42)))

    ws = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    h = [longs(*ws[i : i + 2]) for i in range(max(len(ws) - 1, min(len(ws), 1)))]
    low = fingerprints._PLACES
    seen, ranked = collections.Counter(), []
    for i, x in enumerate(h):
        k = seen[x >> low]
        seen[x >> low] += 1
        top = x >> low if k == 0 else mixed(x >> low, k) >> low
        ranked.append((top, i))
    bins = collections.defaultdict(list)
    for top, i in sorted(ranked):
        if len(bins[top >> 64 - fingerprints.BIN_BITS - low]) < fingerprints.PICK:
            bins[top >> 64 - fingerprints.BIN_BITS - low].append(i)
    sig = {(b & (1 << fingerprints.BIN_BITS) - 1) << 26 | (longs(*[h[i] for i in sorted(own)]) & 2**64 - 1) >> 38 for b, own in bins.items()}
    return "".join(f"{x:08x}" for x in sorted(sig)), sig


def test_order_minhash_brute_force(spark, real):
    text = {r.doc_id: r.text for r in real.collect()}
    ids = sorted(text, reverse=True)
    out = {r.doc_id: r for r in registry.op8_order_minhash(spark, SF).collect()}

    def near(a, b):
        used = {x >> 26 for x in a | b}
        return len(a & b) / len(used) if used else 1.0

    for k, n in zip(ids, ids[1:] + ids[:1]):
        half = len(text[k]) // 2
        own, other, edited = (brute_signature(t) for t in (text[k], text[n], text[k][: len(text[k]) - half] + text[n][:half]))
        assert (out[k].fingerprint, out[k].edited_fingerprint) == (own[0], edited[0])
        assert (out[k].near_edited, out[k].near_next) == (near(own[1], edited[1]), near(own[1], other[1]))


def test_order_minhash_null_ids_in_buckets(spark, monkeypatch):
    rows = [(i, f"text {i}", None, None) for i in range(40)] + [(None, f"nameless {i}", None, None) for i in range(60)]
    for some in (rows, rows[40:], rows[:40]):
        df = docs(spark, some)
        monkeypatch.setattr(fingerprints, "BUCKET", 2000)
        want = sorted(map(tuple, fingerprints.fingerprint_edits(df).collect()), key=repr)
        monkeypatch.setattr(fingerprints, "BUCKET", 3)
        assert sorted(map(tuple, fingerprints.fingerprint_edits(df).collect()), key=repr) == want
        far = df.withColumn("doc_id", F.col("doc_id") + F.lit(2**62))  # beyond what doubles tell apart
        got = fingerprints.fingerprint_edits(far).withColumn("doc_id", F.col("doc_id") - F.lit(2**62)).collect()
        assert sorted(map(tuple, got), key=repr) == want
    with pytest.raises(TypeError):
        fingerprints.fingerprint_edits(df.withColumn("doc_id", F.lit("a")))


def test_order_minhash_is_sensitive_to_order(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    df = spark.createDataFrame([(" ".join(words), " ".join(turned), " ".join(words[:-3]))], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.signature(df, c, f"s{c}")
    r = df.select(fingerprints.likeness(F.col("sa"), F.col("sb")).alias("turned"), fingerprints.likeness(F.col("sa"), F.col("sc")).alias("cut"), fingerprints.likeness(F.col("sa"), F.col("sa")).alias("same")).first()
    assert r.same == 1.0 and r.cut > 0.9 and r.turned < 0.8


def test_order_minhash_repeats_and_buckets(spark, odd, empty, monkeypatch):
    wide = {r.doc_id: r for r in fingerprints.fingerprint_edits(odd.where("doc_id is not null")).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET", 2)
    out = fingerprints.fingerprint_edits(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    narrow = {r.doc_id: r for r in fingerprints.fingerprint_edits(odd.where("doc_id is not null")).collect()}
    assert narrow == wide
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(odd.where("doc_id = 8")).first()
    assert one.near_next == 1.0
    assert "Python" not in out._jdf.queryExecution().toString()


# --- sharding


def brute_rows(n, shards):
    return [n // shards + (s < n % shards) for s in range(shards)]


def test_sharding(spark, real, odd, empty):
    for d in (real, odd):
        rows = sharding.shard_rows(d).collect()
        assert len(rows) == d.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert sorted((len(v) for v in by.values()), reverse=True) == [x for x in sorted(brute_rows(len(rows), 16), reverse=True) if x]
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r.doc_id: r.text for r in real.collect()}
    for r in sharding.shard_rows(real).collect():
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
    assert sharding.shard_rows(empty).count() == 0


def walk_ring(rows, shards):
    """Each key alone goes on clockwise from its place until a shard has room: rounds by hops, then places, then the rows' order."""
    stands = sorted({(zlib.crc32(f"shard {s} node {v}".encode()) % sharding.SLOTS, s) for s in range(shards) for v in range(sharding.VNODES)})
    room, got, waiting = brute_rows(len(rows), shards), {}, sorted(rows, key=lambda r: (r["place"], r["order"]))
    used = [0] * shards

    def ahead(place):
        seen = []
        for _, s in [x for x in stands if x[0] >= place] + [x for x in stands if x[0] < place]:
            if s not in seen:
                seen.append(s)
        return seen

    for hop in range(shards):
        left = []
        for r in waiting:
            s = ahead(r["place"])[hop]
            if used[s] < room[s]:
                got[r["key"]] = (s, used[s])
                used[s] += 1
            else:
                left.append(r)
        waiting = left
    return got


def test_sharding_brute_force(spark, monkeypatch):
    """Every row walks the ring alone; the same rows in another order, and many parts a place, end alike."""
    rng = random.Random(9)
    some = [(rng.randint(0, 60), f"t{rng.randint(0, 400)}", None, f"s{i % 3}") for i in range(300)]
    some = list(dict.fromkeys(some))
    df = docs(spark, some)
    names = [F.col(c) for c in df.columns]
    keyed = df.select("doc_id", F.crc32("text").alias("crc"), "source", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SLOTS)).alias("place"), *[F.xxhash64(*names, F.lit(k)).alias(f"h{k}") for k in (1, 2)]).collect()
    rows = [{"key": (r.doc_id, r.crc, r.h1), "place": r.place, "order": (r.h1 % 2**64, r.h2)} for r in keyed]
    want = sorted((*k[:2], *v) for k, v in walk_ring(rows, 5).items())
    for salts, order in ((8, some), (3, some[::-1]), (1000, sorted(some))):
        monkeypatch.setattr(sharding, "SALTS", salts)
        got = sharding.shard_rows(docs(spark, order).repartition(3), 5).collect()
        assert sorted((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_ring_overflows_clockwise():
    prefer = sharding.preferences(4, slots=64)
    assert all(sorted(p) == [0, 1, 2, 3] for p in prefer)
    runs = sharding.assign({0: 100}, 4)
    first = sharding.preferences(4)[0]
    assert [r["s"] for r in runs] == first and [r["hi"] - r["lo"] for r in runs] == [25] * 4


def test_ring_moves_little():
    counts = {p: 10 for p in range(sharding.SLOTS)}

    def owner(shards):
        return {(r["p"], k): r["s"] for r in sharding.assign(counts, shards) for k in range(r["lo"], r["hi"])}

    a, b = owner(16), owner(17)
    assert np.mean([a[k] != b[k] for k in a]) < 0.4


def test_sharding_is_native(spark, real):
    assert "Python" not in sharding.shard_rows(real)._jdf.queryExecution().toString()
    assert "Python" not in lines.dedup_lines(real)._jdf.queryExecution().toString()


# --- mixing


def test_mixing(spark, real):
    rows = mixing.taken(real, block=16).collect()
    again = mixing.taken(real, block=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    text = {r.doc_id: r for r in real.collect()}
    got, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        src = text[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text))
        assert r.taken <= 3 * r.size
        got[src] += r.taken
        size[src] += r.size
        target[src] = r.target
    assert {r.source_size for r in rows} == set(size.values())
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s, t in target.items():
        assert abs(got[s] - t) < 0.05 * t + 40


def brute_targets(size, weight, most):
    total, fixed = float(sum(size)), {}
    while True:
        free = [i for i in range(len(size)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[i] for i in free)
        over = {i: most * size[i] for i in free if left * weight[i] / w > most * size[i]}
        if not over:
            return [fixed[i] if i in fixed else left * weight[i] / w for i in range(len(size))]
        fixed |= over


def test_targets(spark):
    assert brute_targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert brute_targets([10, 500, 490], [5, 2, 1], 3) == pytest.approx([30, 970 * 2 / 3, 970 / 3])
    rng = random.Random(4)
    for sizes in ([100, 100, 100], [10, 500, 490], [0, 0], [2**i for i in range(30)], [rng.randint(0, 9) ** 5 for _ in range(200)]):
        names = sorted({f"{rng.choice('aé漢🎉Z')}{i}" for i in range(len(sizes) - 1)}) + [None]
        rows = [(n, s) for n, s in zip(names, sizes)]
        rng.shuffle(rows)
        got = sorted(mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect(), key=lambda r: r.source_no)
        assert [r.source for r in got] == names and [r.source_no for r in got] == list(range(len(sizes)))
        assert [r.target for r in got] == pytest.approx(brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3))


def test_mixing_brute_force(spark, real):
    """Every slot of the plan, played through the streams word by word."""
    block = 16
    sized = mixing.sizes(real.withColumn("r", F.monotonically_increasing_id()), "r")
    packed, got = mixing.mix(sized, block=block)
    slots = mixing.plan(mixing.targets(sized), 11, block, mixing.SHARDS).collect()
    streams = collections.defaultdict(dict)
    for r in packed.collect():
        for w in range(r.size):
            assert r.start + w not in streams[r.source_no]
            streams[r.source_no][r.start + w] = r.row
    want, order = collections.Counter(), collections.defaultdict(list)
    for r in slots:
        order[r.source_no].append(r)
        for w in range(r.block_no * block, min(r.block_no * block + r.upto, len(streams[r.source_no]))):
            want[streams[r.source_no][w]] += 1
    have = collections.Counter()
    for r in got.collect():
        have[r.row] += r.hi - r.lo
    assert have == want
    for no, own in order.items():
        own.sort(key=lambda r: r.slot)
        n = -(-len(streams[no]) // block)
        assert [r.slot for r in own] == list(range(len(own))) and [r.shard for r in own] == sorted(r.shard for r in own)
        for e in range(0, len(own), n):
            assert len({r.block_no for r in own[e : e + n]}) == len(own[e : e + n])
            assert {r.epoch for r in own[e : e + n]} == {e // n}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_mixed_documents(spark, real, odd, empty):
    rows = mixing.taken(real, block=16).collect()
    mixed = mixing.mixed_documents(real, block=16).collect()
    got = collections.Counter()
    for r in mixed:
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, v in got.items() if v} == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.taken(odd, block=4).count() == odd.count()
    assert mixing.mixed_documents(odd, block=4).columns == odd.columns
    assert mixing.taken(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


CLASHES = ("fp", "root", "node", "k1", "__k1", "h", "h1", "t", "at", "row", "__row", "start", "size", "bucket", "home", "place", "salt", "shard", "slot", "words", "__words", "text_sha", "sig", "__sorted", "kinds", "__kinds", "lang_score", "ids_", "site", "sites", "first", "__gone")


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHES}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


def test_extra_columns_pass_through(spark, odd):
    """Columns that are named like the operators' own keep their values."""
    odd = odd.where("length(text) < 1000 or text is null")
    n, wide = odd.count(), clashing(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def kept(out, rows=n):
        got = out.collect()
        assert len(got) == rows
        for r in got:
            assert all(r[c] == "mine" for c in CLASHES if c not in ("lang_score",)) and r["m"] == {"a": 1}

    kept(lines.dedup_lines(wide, min_sites=1))
    kept(quality.score_documents(wide, none))
    kept(language.predict(wide))
    kept(pieces.decode(pieces.encode(wide)))
    kept(secret_scan.scan(wide))
    kept(simhash.keep_one(wide), simhash.keep_one(odd).count())
    kept(mixing.mixed_documents(wide, block=4), mixing.mixed_documents(odd, block=4).count())
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(fingerprints.fingerprint_edits(wide)) == rows(fingerprints.fingerprint_edits(odd))
    assert len(rows(sharding.shard_rows(wide))) == n


# --- texts without spaces, repeated ids, languages without a drawn row


@pytest.mark.parametrize("kind", ["base64", "chinese", "one letter", "bytes"])
def test_pieces_of_unbroken_texts(vocabulary, kind):
    """A lone text of 60,000 characters without a space: the library's ids, in well under a second."""
    import time

    import sentencepiece

    rng = random.Random(5)
    alphabet = {"base64": [chr(c) for c in range(48, 123) if chr(c).isalnum()] + ["+", "/"], "chinese": [chr(c) for c in range(0x4E00, 0x9FFF)], "one letter": ["a"], "bytes": ["🎉", "é", "x"]}[kind]
    text = "".join(rng.choice(alphabet) for _ in range(60_000))
    began = time.perf_counter()
    got = vocabulary.encode(text).tolist()
    assert time.perf_counter() - began < 1.5  # .1 s as a rule
    assert got == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)


def test_pieces_of_a_million_unbroken_characters(vocabulary, monkeypatch):
    """The window stays bounded, however long the text."""
    import sentencepiece

    rng, held, find = random.Random(6), [], vocabulary.find
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    monkeypatch.setattr(vocabulary, "find", lambda code, stop: held.append(len(code)) or find(code, stop))
    assert vocabulary.encode(text).tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert max(held) <= 2 * pieces.ALONE


def test_pieces_alone_and_side_by_side_agree(real, vocabulary, monkeypatch):
    texts = [r.text for r in real.where("text is not null").limit(40).collect()]
    monkeypatch.setattr(pieces, "FEW", 0)
    side = [b"".join(x for j, x in vocabulary.walk(texts) if j == k) for k in range(len(texts))]
    monkeypatch.setattr(pieces, "FEW", len(texts))
    assert [b"".join(x for j, x in vocabulary.walk(texts) if j == k) for k in range(len(texts))] == side


def test_quality_of_repeated_ids_does_not_depend_on_order(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = real.unionByName(real.withColumn("text", F.concat(F.lit("other "), F.reverse("text"))))
    a, b = (quality.fit(twice.repartition(n, key), labels, 60) for n, key in ((3, "text"), (7, "lang")))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()
    text_ids = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert quality.fit(text_ids(real), text_ids(labels), 60).linear.any()


def test_a_language_without_a_drawn_row_is_left_out(spark):
    rows = [(i, f"the cat and dog {i}", "en", "a") for i in range(60)] + [(1, "die katze und der hund", "de", "a")] * 1000
    df = docs(spark, rows)
    names, table = language.fit(df, per_language=5)
    drawn = {r.lang for r in df.where(~F.expr("crc32(cast(doc_id as string)) % 5 = 0")).join(df.groupBy("lang").count(), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) / 1e6 < 5 / F.col("count")).select("lang").collect()}
    assert set(names) == drawn and table.shape[1] == len(names)
