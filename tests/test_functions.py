"""Expressions and UDFs on hand-made rows with hand-worked values."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from contentlens.functions import attacks, calibration, provenance, signing, texts, udfs
from contentlens.functions.decisions import POLICIES, label_zone, normal_upper_tail, psi_class, trust_state


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


@pytest.mark.parametrize("policy,score,want", [
    ("detector", 0.70, "AI"), ("detector", 0.30, "HUMAN"), ("detector", 0.5, "UNCERTAIN"), ("engine", 0.40, "HUMAN"), ("engine", 0.70, "UNCERTAIN"),
    ("fallback", 0.55, "UNCERTAIN"), ("fallback", 0.40, "UNCERTAIN"), ("fallback", 0.5501, "AI"), ("sentence", 0.61, "AI"), ("four_layers", 0.75, "AI"),
])
def test_policies(spark, policy, score, want):
    assert policy in POLICIES
    assert one(spark, [(score,)], "s double", z=label_zone(F.col("s"), policy))[0].z == want


def test_psi_edges(spark):
    values = [0.05, 0.099, 0.10, 0.20, 0.249999, 0.25, 0.50]
    got = [r.c for r in one(spark, [(v,) for v in values], "p double", c=psi_class(F.col("p")))]
    assert got == ["STABLE"] * 2 + ["MODERATE"] * 3 + ["SIGNIFICANT"] * 2


def test_trust(spark):
    rows = [(0.7, 0.95, 0.05, "green"), (0.7, 0.95, None, "orange"), (0.7, 0.95, 0.3, "red"), (0.5, 0.8, 0.2, "orange"), (0.3, 0.99, 0.0, "red"), (0.9, None, 0.0, "gray")]
    for c, r, p, want in rows:
        assert one(spark, [(c, r, p)], "c double, r double, p double", t=trust_state(F.col("c"), F.col("r"), F.col("p")))[0].t == want


def test_normal_tail(spark):
    for z in (-2.5, 0.0, 0.7, 3.0):
        want = 0.5 * (1 - math.erf(z / math.sqrt(2)))
        assert abs(one(spark, [(z,)], "z double", p=normal_upper_tail(F.col("z")))[0].p - want) < 2e-7


def test_cleaning(spark):
    text = "An Essay\n\n# Head\n- item “quoted” — a\n\n\n\nend  "
    row = one(spark, [(text, "a\x00b  c\t\td [EDIT] x === y", "Hi. Click here to read more and\nall goes")], "a string, b string, c string",
              n=texts.normalize(F.col("a")), c=texts.clean(F.col("b")), b=texts.clean(F.col("c")))[0]
    assert row.n == 'item "quoted" - a\n\nend'
    assert row.c == "ab c d x y" and row.b == "Hi."


def test_tone_and_sentences(spark):
    rows = [("lol I gonna do it!!",), ("Furthermore, this is significant.",), ("plain",), ("",)]
    assert [r.t for r in one(spark, rows, "x string", t=texts.tone(F.col("x")))] == ["casual", "formal", "medium", "medium"]
    s = one(spark, [("One two three. Four five six! seven? Eight.",)], "x string", s=texts.sentences(F.col("x"), 3))[0].s
    assert s == ["One two three.", "Four five six! seven?"]


def test_truncate(spark):
    long = "a" * 100 + ". " + "b" * 3000
    r = one(spark, [(long, "x" * 3000, "short")], "a string, b string, c string", a=texts.truncate(F.col("a")), b=texts.truncate(F.col("b")), c=texts.truncate(F.col("c")), s=texts.stored(F.col("b")))[0]
    assert r.a == "a" * 100 + "." and r.b == "x" * 2000 and r.c == "short" and len(r.s) < 3000


def test_html(spark):
    page = "<p>A &amp; B</p><script>x<y</script><!-- c --><style>p{}</style> &lt;ok&gt;"
    assert one(spark, [(page,)], "h string", t=texts.html_text(F.col("h")))[0].t == "A & B <ok>"
    assert one(spark, [("caf&eacute; &amp;",)], "h string", t=udfs.unescape(F.col("h")))[0].t == "café &"


def test_two_word_entries_never_match(spark):
    df = texts.stylometry(spark.createDataFrame([("Kind of a well made thing. You know it is so. It went well anyway.",)], "text string"))
    r = df.first()
    assert r.human_casual_rate == pytest.approx(5 / 15, abs=1e-4) and r.initial_diversity == 1.0


def test_compose_and_sign(spark):
    r = one(spark, [("é", "p"), (None, None)], "t string, p string", c=udfs.compose(F.col("t")), s=signing.sign(F.col("p"), "k"))
    assert r[0].c == "é" and r[0].s == hmac.new(b"k", b"p", hashlib.sha256).hexdigest() and r[1].c is None and r[1].s is None


def test_rewrites_are_seeded(spark):
    text = "I do not know. It is big. We cannot show it. That is good. They are not here."
    df = spark.createDataFrame([(i, text) for i in range(8)], "id long, text string")
    cols = dict(a=udfs.humanised(F.col("text"), F.col("id")), b=udfs.formalised(F.col("text"), F.col("id")), c=udfs.interleaved(F.col("text"), F.lit("Another sentence that is long enough. And one more that is long."), F.col("id")))
    x, y = ([tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).orderBy("a").collect()] for _ in range(2))
    assert x == y and any("don't" in r[0] for r in x) and len({r[0] for r in x}) > 1


@pytest.mark.parametrize("kind", ["shuffle", "synonym", "zwsp", "homoglyph"])
def test_attacks(spark, kind):
    text = "The big show is good. We use the small one and get it. " * 10
    attack = lambda amount: one(spark, [(text,), (None,), ("",)], "t string", a=attacks.ATTACKS[kind](F.col("t"), amount))
    high, low = attack(100), attack(0)
    assert [r.a for r in high[1:]] == [None, ""] and (kind == "homoglyph" or low[0].a.split() == text.split())
    r = high[0].a
    assert r != text and (kind != "zwsp" or r.replace("\u200b", "") == text) and (kind != "shuffle" or sorted(r.replace(".", "").split()) == sorted(text.replace(".", "").split()))
    assert kind != "synonym" or r.startswith("The large demonstrate are great. We utilise a tiny one and obtain it.")
    assert kind != "homoglyph" or attacks.swap_glyphs is attacks.ATTACKS[kind] and set(r) & set(attacks.GLYPHS) == set()


@pytest.mark.parametrize("kind, strength", [(k, s) for k in attacks.STRENGTHS for s in attacks.STRENGTHS[k]])
def test_attacks_change_the_share_of_their_strength(spark, kind, strength):
    amount = attacks.STRENGTHS[kind][strength]
    words = [f"w{i}" for i in range(8)]
    text = {"shuffle": ". ".join(" ".join(words) for _ in range(9)), "synonym": " ".join(["big"] * 200), "zwsp": "x" * 300, "homoglyph": "a" * 300}[kind]
    got = one(spark, [(text,)], "t string", a=attacks.ATTACKS[kind](F.col("t"), amount))[0].a
    changed = {
        "shuffle": lambda: sum(s != " ".join(words) for s in got.split(". ")), "synonym": lambda: got.split().count("large") * 100 / 200,
        "zwsp": lambda: got.count("\u200b") * 100 / 300, "homoglyph": lambda: got.count("а") * 100 / 300,
    }[kind]()
    assert changed == amount


def test_bytes(spark):
    rows = [(bytearray(b"\x89PNG\r\n\x1a\nxx"), "image/png", True), (bytearray(b"RIFF1234WEBP"), "image/webp", True), (bytearray(b"RIFF1234WAVE"), "image/webp", False), (bytearray(b"hello"), "text/plain", True), (bytearray(b""), "image/png", False)]
    for data, mime, want in rows:
        assert one(spark, [(data, mime)], "d binary, m string", ok=udfs.signature_ok(F.col("d"), F.col("m")))[0].ok is want
    m = one(spark, [({"Password": "x", "name": "y"},)], "m map<string,string>", r=udfs.redact(F.col("m")))[0].r
    assert m == {"Password": "***", "name": "y"}
    p = one(spark, [(bytearray(b"%PDF /Type /Page /Type /Pages /JS startxref startxref"),)], "d binary", p=udfs.pdf_marks(F.col("d")))[0].p
    assert (p.xrefs, p.script, p.pages) == (2, True, 1)


def test_code(spark):
    src = 'def some_name(a: int, b):\n    """doc"""\n    # note\n    camelCase = 1\n    return a\n'
    df = spark.createDataFrame([(src,), ("def (",)], "s string")
    r = df.select(udfs.code_features(F.col("s")).alias("f"), *[c.alias(n) for n, c in udfs.naming(F.col("s")).items()], udfs.strip_comments(F.col("s")).alias("bare")).collect()
    assert r[0].f.functions == 1 and r[0].f.docstrings == 1 and r[0].f.annotated == 0.5 and r[1].f.functions is None
    assert r[0].snake > 0 and r[0].camel > 0 and "# note" not in r[0].bare


def test_media(spark):
    pixels = [float((i * 37 + j * 17) % 256) for i in range(16) for j in range(16)]
    wave = [math.sin(i / 5) for i in range(512)]
    r = spark.createDataFrame([(pixels, 16, wave, 16000)], "p array<double>, w int, s array<double>, r int").select(
        udfs.image_features(F.col("p"), F.col("w")).alias("i"), udfs.voice_features(F.col("s"), F.col("r")).alias("v"), udfs.image_watermark(F.col("p"), F.col("w")).alias("z")).first()
    assert 0 <= r.i.symmetry <= 1 and r.i.noise > 0 and 400 < r.v.centroid < 700 and abs(r.z) <= 2.1


def test_calibration(spark):
    rows = [(i / 200, int((i * 7919) % 200 < i)) for i in range(200)]
    train = spark.createDataFrame(rows, "score double, label int")
    out = calibration.fit_calibration(train)(train).orderBy("score").collect()
    assert all(0.01 <= r.calibrated <= 0.99 for r in out) and out[0].calibrated < 0.2 < 0.8 < out[-1].calibrated
    meta = calibration.fit_meta(train.withColumn("other", F.lit(0.3)), ["score", "other"])
    assert meta(spark.createDataFrame([(0.9, None)], "score double, other double")).first().meta > 0.5


def test_passports(spark):
    df = provenance.issue(spark.createDataFrame([(1, "text one"), (2, "text two")], "id long, text string"), F.col("text"), "me", "key", kind=F.lit("text"))
    check = lambda d, key="key": {r.id: r.verdict for r in provenance.verify(d, F.col("text"), key).collect()}
    assert check(df) == {1: "valid", 2: "valid"}
    assert check(df.withColumn("text", F.lit("text one"))) == {1: "valid", 2: "changed"}
    assert set(check(df, "other").values()) == {"forged"}
    assert set(check(df.withColumn("passport", F.when(F.col("id") > 9, F.col("passport")))).values()) == {"missing"}
    marks = one(spark, [(bytearray(b"xx c2pa jumb"),)], "d binary", m=provenance.byte_marks(F.col("d")))[0].m
    assert marks == ["c2pa", "jumb"]
    shifted = bytearray.fromhex("0" + b"c2pa".hex() + "0")  # the digits of a mark, across bytes
    assert one(spark, [(shifted,)], "d binary", m=provenance.byte_marks(F.col("d")))[0].m == []


def test_faces(spark):
    flat, odd = [5.0] * 64, [float((i * 31) % 97) for i in range(64)]
    r = spark.createDataFrame([(flat, 8), (odd, 8), (None, 8)], "p array<double>, w int").select(udfs.face_artifacts(F.col("p"), F.col("w")).alias("f")).collect()
    assert r[0].f.sharpness == 0 and r[0].f.texture == 0 and r[1].f.sharpness > 0 and r[1].f.texture > 1
