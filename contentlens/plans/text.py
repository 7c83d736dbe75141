"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentlens.functions import attacks
from contentlens.functions import lexicons as lex
from contentlens.functions import texts as t
from contentlens.functions import udfs
from contentlens.functions.decisions import clip, label_zone
from contentlens.plans.base import query, r6, table

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sents(least: int) -> str:
    return rf"list_filter({SPLIT}, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= {least})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _chain(patterns: list[str], flags: str, start: str) -> str:
    for p in patterns:
        start = "regexp_replace(" + start + ", '" + p.replace("'", "''").replace(r"•", "•") + f"', '', '{flags}')"
    return start


ASCII = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / greatest(length(text), 1)"


@query(rf"""WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents)
SELECT doc_id, (length({STRIP.format('text')}) >= 80 AND {ASCII} > 0.85) AS valid_text,
  (len(w) BETWEEN 50 AND 1200 AND coalesce(len(list_distinct(list_transform(w, lambda x: lower(x)))) / nullif(len(w), 0), 0) >= 0.25 AND {ASCII} >= 0.7) AS valid_sample,
  (length(text) >= 100) AS v1_valid, CASE WHEN length(text) >= 1000 THEN 'formal' WHEN length(text) >= 500 THEN 'fallback' WHEN length(text) >= 300 THEN 'casual' WHEN length(text) >= 200 THEN 'review' WHEN length(text) >= 150 THEN 'email' END AS hard_negative
FROM w""")
def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01 F-02 F-03 F-04 S-06: validity of a text under each corpus's rules."""
    text, w = F.col("text"), F.col("w")
    d = _docs(spark, sf_dir).withColumn("w", t.split_words(text))
    distinct = F.coalesce(F.try_divide(F.size(F.array_distinct(F.transform(w, F.lower))), F.size(w)), F.lit(0.0))
    n = F.length(text)
    return d.select(
        "doc_id", ((F.length(t.strip(text)) >= 80) & (t.ascii_share(text) > 0.85)).alias("valid_text"),
        (F.size(w).between(50, 1200) & (distinct >= 0.25) & (t.ascii_share(text) >= 0.7)).alias("valid_sample"), (n >= 100).alias("v1_valid"),
        F.when(n >= 1000, "formal").when(n >= 500, "fallback").when(n >= 300, "casual").when(n >= 200, "review").when(n >= 150, "email").alias("hard_negative"),
    )


_NORMAL = "translate(" + STRIP.format(r"regexp_replace(" + _chain(lex.HEADERS, "gm", _chain(lex.TITLES, "gim", "text")) + r", '\n{3,}', chr(10) || chr(10), 'g')") + ", '‘’“”–—', '''''\"\"--')"


@query(f"SELECT doc_id, md5({_NORMAL}) AS normal_md5, length({_NORMAL}) AS n FROM documents".replace("'gm'", "'gn'").replace("'gim'", "'gin'"))
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-01: formatting that gives the author away is stripped."""
    d = _docs(spark, sf_dir).withColumn("x", t.normalize(F.col("text")))
    return d.select("doc_id", F.md5(F.col("x").cast("binary")).alias("normal_md5"), F.length("x").cast("long").alias("n"))


_CASUAL = " + ".join([f"contains(lower(text), '{s}')::INT" for s in lex.CASUAL_TONE] + [f"contains(text, '{s}')::INT" for s in lex.CASUAL_MARKS] + [f"regexp_matches(lower(text), '{lex.CASUAL_PATTERN}')::INT"])
_FORMAL = " + ".join([f"contains(lower(text), '{s}')::INT" for s in lex.FORMAL_TONE] + [f"regexp_matches(lower(text), '{lex.FORMAL_PATTERN}')::INT"])


@query(f"SELECT doc_id, CASE WHEN {_CASUAL} >= 3 THEN 'casual' WHEN {_FORMAL} >= 2 THEN 'formal' ELSE 'medium' END AS tone FROM documents")
def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-02: casual wins over formal."""
    return _docs(spark, sf_dir).select("doc_id", t.tone(F.col("text")).alias("tone"))


_CUT = "greatest(CASE WHEN contains(head, '. ') THEN length(head) - instr(reverse(head), ' .') - 1 ELSE -1 END, CASE WHEN contains(head, '.' || chr(10)) THEN length(head) - instr(reverse(head), chr(10) || '.') - 1 ELSE -1 END)"


@query(f"""WITH h AS (SELECT doc_id, text, substr(text, 1, 2000) AS head FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text WHEN {_CUT} > 80 THEN substr(head, 1, {_CUT} + 1) ELSE head END) AS cut_md5,
  md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 1000) || chr(10) || '...[truncated]...' || chr(10) || right(text, 1000) ELSE text END) AS stored_md5 FROM h""")
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-03 T-36: cut at a sentence end, and what a sample log stores."""
    md5 = lambda c: F.md5(c.cast("binary"))
    return _docs(spark, sf_dir).select("doc_id", md5(t.truncate(F.col("text"))).alias("cut_md5"), md5(t.stored(F.col("text"))).alias("stored_md5"))


_CTRL = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_CLEAN = STRIP.format(r"regexp_replace(regexp_replace(" + STRIP.format(_chain(lex.BOILERPLATE, "gis", _CTRL)) + r", '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")


@query(f"SELECT doc_id, md5({_CLEAN}) AS clean_md5, length({_CLEAN}) AS n FROM documents")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-06 T-07 T-08: controls, boilerplate and white space."""
    d = _docs(spark, sf_dir).withColumn("x", t.clean(F.col("text")))
    return d.select("doc_id", F.md5(F.col("x").cast("binary")).alias("clean_md5"), F.length("x").cast("long").alias("n"))


@query(rf"""SELECT doc_id, len({TOKENS}) AS n_tokens, len({WORDS}) AS n_words, len({SPLIT}) AS n_pieces, len({sents(4)}) AS n_sentences4, len({sents(3)}) AS n_sentences3,
  greatest(len(list_filter(string_split(text, '.'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= 4)), 1) AS n_dot_sentences FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-09 T-10 T-11 T-12 T-13: tokens and sentences under each definition."""
    text = F.col("text")
    dots = F.filter(F.split(text, r"\."), lambda s: F.size(t.split_words(s)) >= 4)
    n = lambda c: F.size(c).cast("long")
    return _docs(spark, sf_dir).select(
        "doc_id", n(t.tokens(text)).alias("n_tokens"), n(t.split_words(text)).alias("n_words"), n(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")).alias("n_pieces"),
        n(t.sentences(text, 4)).alias("n_sentences4"), n(t.sentences(text, 3)).alias("n_sentences3"), F.greatest(n(dots), F.lit(1)).alias("n_dot_sentences"),
    )


def _count(part: str) -> str:
    return f"((length(text) - length(replace(text, '{part}', ''))) / {len(part)})"


_RATES = {"comma": ",", "semicolon": ";", "colon": ":", "em_dash": "—", "hyphen": "-", "exclaim": "!", "question": "?", "ellipsis": "...", "paren": "("}
_IN = lambda ws: f"len(list_filter(w, lambda x: list_contains({_list(ws)}, x)))"
_STYLE = rf"""b AS (SELECT doc_id, text, {TOKENS} AS w, {sents(3)} AS s, greatest(len({WORDS}), 1) AS nw FROM documents),
l AS (SELECT *, greatest(len(w), 1) AS n, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS ls,
  list_transform(s, lambda x: lower(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')[1])) AS firsts FROM b),
m AS (SELECT *, coalesce(list_sum(ls) / len(ls), 0) AS mean FROM l),
v AS (SELECT *, coalesce(sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / len(ls)), 0) AS std FROM m),
f AS (SELECT doc_id, round_even(mean, 3) AS sent_mean, round_even(std, 3) AS sent_std,
  round_even(CASE WHEN std > 0 AND len(ls) >= 3 THEN list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean) * (x - mean))) / len(ls) / (std * std * std) ELSE 0 END, 3) AS sent_skew,
  coalesce(list_min(ls), 0) AS sent_min, coalesce(list_max(ls), 0) AS sent_max,
  {", ".join(f"{_count(p)} / nw AS {n}_rate" for n, p in _RATES.items())},
  round_even(len(list_distinct(w)) / n, 4) AS type_token_ratio, round_even({_IN(lex.FUNCTION_WORDS)} / n, 4) AS func_word_rate, round_even({_IN(lex.HEDGES)} / n, 4) AS ai_hedge_rate,
  round_even({_IN(lex.CASUALS)} / n, 4) AS human_casual_rate, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n, 9) AS avg_word_length,
  CASE WHEN len(s) >= 3 THEN round_even(len(list_distinct(firsts)) / len(firsts), 4) END AS initial_diversity FROM v),
scored AS (SELECT *, round_even(greatest(0.01, least(0.99, (greatest(0, 1 - sent_std / 15) + least(ai_hedge_rate * 80, 1) + greatest(0, 1 - human_casual_rate * 50) + greatest(0, 1 - type_token_ratio / 0.7)
  + greatest(0, 1 - coalesce(initial_diversity, 0.7)) + least(em_dash_rate * 200, 1) + least(greatest(0, (comma_rate - 0.05) / 0.1), 1)) / 7)), 4) AS score FROM f)"""


@query(f"WITH {_STYLE} SELECT doc_id, {', '.join(f'round({n}_rate, 6) AS {n}_rate' for n in _RATES)} FROM f")
def punctuation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-14: nine marks by word."""
    d = t.stylometry(_docs(spark, sf_dir))
    return d.select("doc_id", *[r6(F.col(f"{n}_rate")).alias(f"{n}_rate") for n in _RATES])


_LEX = ("sent_mean", "sent_std", "sent_skew", "sent_min", "sent_max", "type_token_ratio", "func_word_rate", "ai_hedge_rate", "human_casual_rate", "avg_word_length", "initial_diversity", "score")


@query(f"WITH {_STYLE} SELECT doc_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LEX)} FROM scored")
def stylometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-15 T-16 T-17 T-18 T-19: lexical and sentence features and their score."""
    d = t.stylometry(_docs(spark, sf_dir))
    return d.select("doc_id", *[F.col(c).cast("double").alias(c) for c in _LEX])


@query(rf"""WITH x AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS rn FROM c),
g AS (SELECT doc_id, max(n) AS top, min(n) AS last, count(*) AS k FROM r WHERE rn <= 20 GROUP BY 1)
SELECT doc_id, CASE WHEN k >= 2 THEN round(last / top, 4) ELSE 0.0 END AS freq_drop FROM g""")
def frequency_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-15: the twentieth frequency over the first."""
    c = _docs(spark, sf_dir).select("doc_id", F.explode(t.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    top = c.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n")))).where("rn <= 20")
    g = top.groupBy("doc_id").agg(F.max("n").alias("top"), F.min("n").alias("last"), F.count(F.lit(1)).alias("k"))
    return g.select("doc_id", F.when(F.col("k") >= 2, F.round(F.col("last") / F.col("top"), 4)).otherwise(0.0).alias("freq_drop"))


@query(rf"""WITH s AS (SELECT doc_id, unnest({sents(3)}) AS text, generate_subscripts({sents(3)}, 1) - 1 AS place FROM documents),
w AS (SELECT doc_id, place, {TOKENS} AS w FROM s), n AS (SELECT *, greatest(len(w), 1) AS n FROM w)
SELECT doc_id, CAST(place AS INTEGER) AS place, round(greatest(0.01, least(0.99, 0.5 + {_IN(lex.HEDGES)} / n * 20 - {_IN(lex.CASUALS)} / n * 10)), 4) AS score FROM n""")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-20 R-02: a score for each sentence."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(F.col("text"), 3)).alias("place", "s")).withColumn("w", t.tokens(F.col("s")))
    n = F.greatest(F.size("w"), F.lit(1))
    score = clip(0.5 + t.among(F.col("w"), lex.HEDGES) / n * 20 - t.among(F.col("w"), lex.CASUALS) / n * 10)
    return s.select("doc_id", "place", F.round(score, 4).alias("score"))


def _heuristic(df: DataFrame) -> DataFrame:
    """Adds s1 to s10 and score: the fallback scorer's signals, from tokens and sentences made once."""
    x = F.col("text")
    df = df.withColumn("__w", t.tokens(x)).withColumn("__s", t.sentence_words(x, 3)).withColumn("__lw", t.split_words(F.lower(x)))
    df = df.withColumn("__s", F.when(F.size("__s") > 0, F.col("__s")).otherwise(F.array(t.split_words(x))))
    df = df.withColumn("__len", F.transform("__s", F.size)).withColumn("__first", F.transform("__s", lambda ws: F.lower(F.get(ws, F.lit(0)))))
    n, w, zero, one = F.greatest(F.size("__w"), F.lit(1)), F.col("__w"), F.lit(0.0), F.lit(1.0)
    std = F.when(F.size("__len") > 1, t.moments(F.col("__len"))["std"]).otherwise(10.0)
    ttr, ceiling = F.size(F.array_distinct("__w")) / n, F.when(n >= 200, 0.7).otherwise(0.7 + 0.3 * (200 - n) / 200)
    sid = F.when(F.size("__s") >= 3, F.size(F.array_distinct("__first")) / F.size("__first")).otherwise(0.7)
    short = t.among(F.col("__lw"), lex.CONTRACTIONS)
    signals = [
        F.greatest(zero, 1 - std / 15), F.least(t.among(w, lex.HEDGES) / n * 80, one), F.greatest(zero, 1 - t.among(w, lex.MORE_CASUALS) / n * 50),
        F.greatest(zero, 1 - ttr / ceiling), F.greatest(zero, 1 - sid), F.least(0.5 + t.occurrences(x, "—") / n * 100, one),
        F.least(F.greatest(zero, (t.occurrences(x, ",") / n - 0.03) / 0.08), one),
        F.when(short == 0, F.when(F.length(x) >= 500, 1.0).otherwise(0.8)).otherwise(F.greatest(zero, 1 - short * 0.3)),
        F.least(F.greatest(zero, (t.lengths(w) / n - 4) / 4), one),
        F.greatest(zero, 1 - t.among(w, lex.FIRST_PERSON) / n * 20),
    ]
    df = df.withColumns({f"s{i + 1}": s for i, s in enumerate(signals)}).drop("__w", "__s", "__lw", "__len", "__first")
    weights = (1.5, 2.5, 1.0, 0.5, 0.5, 0.5, 0.5, 2.0, 1.0, 2.0)
    return df.withColumn("score", clip(sum((F.col(f"s{i + 1}") * v for i, v in enumerate(weights)), F.lit(0.0)) / sum(weights)))


_HEUR = rf"""b AS (SELECT doc_id, text, {TOKENS} AS w, {sents(3)} AS s0, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS lw FROM documents),
a AS (SELECT *, greatest(len(w), 1) AS n, CASE WHEN len(s0) > 0 THEN s0 ELSE [text] END AS s FROM b),
l AS (SELECT *, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS ls, list_transform(s, lambda x: lower(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')[1])) AS firsts,
  len(list_filter(lw, lambda x: list_contains({_list(lex.CONTRACTIONS)}, x))) AS short FROM a),
g AS (SELECT *, list_sum(ls) / len(ls) AS mean FROM l),
sig AS (SELECT doc_id, text, greatest(0, 1 - (CASE WHEN len(ls) > 1 THEN sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / len(ls)) ELSE 10.0 END) / 15) AS s1,
  least({_IN(lex.HEDGES)} / n * 80, 1) AS s2, greatest(0, 1 - {_IN(lex.MORE_CASUALS)} / n * 50) AS s3,
  greatest(0, 1 - (len(list_distinct(w)) / n) / (CASE WHEN n >= 200 THEN 0.7 ELSE 0.7 + 0.3 * (200 - n) / 200 END)) AS s4,
  greatest(0, 1 - CASE WHEN len(s) >= 3 THEN len(list_distinct(firsts)) / len(firsts) ELSE 0.7 END) AS s5, least(0.5 + {_count(chr(0x2014))} / n * 100, 1) AS s6,
  least(greatest(0, ({_count(',')} / n - 0.03) / 0.08), 1) AS s7, CASE WHEN short = 0 THEN CASE WHEN length(text) >= 500 THEN 1.0 ELSE 0.8 END ELSE greatest(0, 1 - short * 0.3) END AS s8,
  least(greatest(0, (coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n - 4) / 4), 1) AS s9, greatest(0, 1 - {_IN(lex.FIRST_PERSON)} / n * 20) AS s10 FROM g),
h AS (SELECT *, greatest(0.01, least(0.99, (s1 * 1.5 + s2 * 2.5 + s3 + s4 * 0.5 + s5 * 0.5 + s6 * 0.5 + s7 * 0.5 + s8 * 2 + s9 + s10 * 2) / 12)) AS score FROM sig)"""


@query(f"""WITH {_HEUR} SELECT doc_id, round(score, 5) AS score, round(0.5 + abs(score - 0.5) * 0.8, 5) AS confidence,
  CASE WHEN score > 0.55 THEN 'AI' WHEN score < 0.4 THEN 'HUMAN' ELSE 'UNCERTAIN' END AS label,
  round(greatest(0.01, least(0.99, (s1 * 2 + s4 + s5 + s7) / 5)), 5) AS perplexity, round(greatest(0.01, least(0.99, (s2 * 2 + s3 + s8 * 1.5 + s9 + s10 * 1.5) / 7)), 5) AS stylometry,
  round(greatest(0.01, least(0.99, (s1 * 1.5 + s6 + s7 + s8 * 1.5) / 5)), 5) AS adversarial FROM h""")
def heuristic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-23 T-24: the ten-signal scorer and its derived layer scores."""
    h, c = _heuristic(_docs(spark, sf_dir)), F.col
    r5 = lambda x: F.round(x, 5)
    return h.select(
        "doc_id", r5(c("score")).alias("score"), r5(0.5 + F.abs(c("score") - 0.5) * 0.8).alias("confidence"), label_zone(c("score"), "fallback").alias("label"),
        r5(clip((c("s1") * 2 + c("s4") + c("s5") + c("s7")) / 5)).alias("perplexity"),
        r5(clip((c("s2") * 2 + c("s3") + c("s8") * 1.5 + c("s9") + c("s10") * 1.5) / 7)).alias("stylometry"),
        r5(clip((c("s1") * 1.5 + c("s6") + c("s7") + c("s8") * 1.5) / 5)).alias("adversarial"),
    )


@query(rf"""WITH s AS (SELECT doc_id, unnest({sents(3)}) AS text, generate_subscripts({sents(3)}, 1) - 1 AS place FROM documents),
w AS (SELECT *, {TOKENS} AS w, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS lw FROM s),
f AS (SELECT doc_id, place, greatest(len(w), 1) AS n, {_IN(lex.HEDGES)} AS hedge, {_IN(lex.MORE_CASUALS)} AS casual, len(list_filter(lw, lambda x: list_contains({_list(lex.CONTRACTIONS)}, x))) > 0 AS short,
  len(list_filter(lw, lambda x: list_contains({_list(lex.FIRST_PERSON)}, x))) AS fp, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) AS awl FROM w),
p AS (SELECT *, greatest(0.01, least(0.99, 0.5 + hedge / n * 15 - casual / n * 10 - CASE WHEN short THEN 0.2 ELSE 0 END + CASE WHEN NOT short AND n >= 8 THEN 0.08 ELSE 0 END + CASE WHEN casual = 0 AND n >= 5 THEN 0.05 ELSE 0 END
  + greatest(0, (awl - 4.5) / 6) * 0.12 - fp * 0.12)) AS score FROM f)
SELECT doc_id, CAST(place AS INTEGER) AS place, round(score, 9) AS score, CASE WHEN score > 0.6 THEN 'AI' WHEN score < 0.4 THEN 'HUMAN' ELSE 'UNCERTAIN' END AS label FROM p""")
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-25: eight additive terms a sentence."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(F.col("text"), 3)).alias("place", "s"))
    s = s.withColumn("w", t.tokens(F.col("s"))).withColumn("lw", t.split_words(F.lower("s")))
    n, casual, short = F.greatest(F.size("w"), F.lit(1)), t.among(F.col("w"), lex.MORE_CASUALS), t.among(F.col("lw"), lex.CONTRACTIONS) > 0
    awl = t.lengths(F.col("w")) / n
    s = s.withColumn("score", clip(
        0.5 + t.among(F.col("w"), lex.HEDGES) / n * 15 - casual / n * 10 - F.when(short, 0.2).otherwise(0.0) + F.when(~short & (n >= 8), 0.08).otherwise(0.0)
        + F.when((casual == 0) & (n >= 5), 0.05).otherwise(0.0) + F.greatest(F.lit(0.0), (awl - 4.5) / 6) * 0.12 - t.among(F.col("lw"), lex.FIRST_PERSON) * 0.12
    ))
    return s.select("doc_id", "place", F.round("score", 9).alias("score"), label_zone(F.col("score"), "sentence").alias("label"))


def _watermark_sql(green: str) -> str:
    return rf"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {green}) AS n_green FROM w GROUP BY 1), z AS (SELECT *, CASE WHEN n >= 50 THEN (n_green / n - 0.5) / sqrt(0.25 / n) END AS z FROM g)"""


def _watermark(spark: SparkSession, sf_dir: str, green) -> DataFrame:
    w = _docs(spark, sf_dir).select("doc_id", t.split_words(F.lower("text")).alias("w"))
    g = w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.filter("w", green)).cast("long").alias("n_green")).where("n > 0")
    return g.withColumn("z", F.when(F.col("n") >= 50, (F.col("n_green") / F.col("n") - 0.5) / F.sqrt(0.25 / F.col("n"))))


@query(_watermark_sql("list_contains(['0','2','4','6','8','a','c','e'], right(sha256('contentlens:' || w), 1))") + """
SELECT doc_id, n, n_green, round(z, 4) AS z, coalesce(z > 3, false) AS detected, coalesce(round(least(abs(z) / 6, 1), 4), 0) AS confidence, coalesce(z > 4.5, false) AS survives FROM z""")
def watermark_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-30: one-sided z test on the parity of a keyed hash; the p value is functions.decisions.normal_upper_tail."""
    z = _watermark(spark, sf_dir, lambda x: F.right(F.sha2(F.concat(F.lit("contentlens:"), x), 256), F.lit(1)).isin(*"02468ace"))
    return z.select("doc_id", "n", "n_green", F.round("z", 4).alias("z"), F.coalesce(F.col("z") > 3, F.lit(False)).alias("detected"), F.coalesce(F.round(F.least(F.abs("z") / 6, F.lit(1.0)), 4), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("z") > 4.5, F.lit(False)).alias("survives"))


@query(_watermark_sql("list_contains(['0','2','4','6','8','a','c','e'], right(md5(w), 1))") + " SELECT doc_id, n, n_green, round(z, 4) AS z, coalesce(abs(z) > 3, false) AS detected FROM z")
def watermark_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-31: two-sided test on the parity of md5."""
    z = _watermark(spark, sf_dir, lambda x: F.right(F.md5(x.cast("binary")), F.lit(1)).isin(*"02468ace"))
    return z.select("doc_id", "n", "n_green", F.round("z", 4).alias("z"), F.coalesce(F.abs("z") > 3, F.lit(False)).alias("detected"))


#: The md5 of each seed and distinct shingle, numbered in its order within the seed (r), and the least number of each document (l).  Shingles are
#: put together from a list of characters, in one walk over a text.
_LEAST = ", ".join(f"min(k[{i + 1}]) AS m{i}" for i in range(100))
_MINHASH = f"""s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(c) - 2, 1) + 1), lambda i: concat(c[i], c[i + 1], c[i + 2])))) AS x FROM (SELECT doc_id, string_split(lower(text), '') AS c FROM documents WHERE text IS NOT NULL)),
v AS (SELECT x, seed, md5(seed || ':' || x) AS least, CAST(row_number() OVER (PARTITION BY seed ORDER BY least) AS INTEGER) AS r FROM (SELECT DISTINCT x FROM s), range(100) t(seed)),
k AS (SELECT x, list(r ORDER BY seed) AS k FROM v GROUP BY x), m AS (SELECT doc_id, {_LEAST} FROM s JOIN k USING (x) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(range(100)) AS seed, unnest([{', '.join(f'm{i}' for i in range(100))}]) AS r FROM m)"""


@query(f"WITH {_MINHASH} SELECT doc_id, CAST(seed AS VARCHAR) AS seed, least FROM l JOIN v USING (seed, r)")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-32: a hundred seeded minima over character shingles of each document."""
    return t.minhash(_docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {_MINHASH}, w AS (SELECT doc_id, list(r ORDER BY seed) AS sig FROM l GROUP BY 1), n AS (SELECT min(doc_id) AS name, sig FROM w GROUP BY sig),
b AS (SELECT name, i AS band, sig[5 * i + 1 : 5 * i + 5] AS k FROM n, range(20) t(i)),
c AS (SELECT DISTINCT x.name AS a, y.name AS b FROM b x JOIN b y ON x.band = y.band AND x.k = y.k AND x.name < y.name),
p AS (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 100 AS similarity FROM c JOIN n x ON x.name = a JOIN n y ON y.name = b)
SELECT name AS a, doc_id AS b, 1.0::DOUBLE AS similarity FROM w JOIN n USING (sig) WHERE name <> doc_id UNION ALL SELECT a, b, similarity FROM p WHERE similarity >= 0.85""")
def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-33 T-34 J-13: documents of one signature, and pairs that share one of 20 bands of 5 and match in at least .85 of their signatures."""
    return t.near_duplicates(_docs(spark, sf_dir), "doc_id", "text")


_HTML = "html"
for _p, _f in ((r"<script[^>]*>.*?</script>", "gis"), (r"<style[^>]*>.*?</style>", "gis"), (r"<!--.*?-->", "gs"), (r"<[^>]+>", "g")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', '{_f}')"
for _n, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_n}', '{_c}')"
_HTML = STRIP.format(rf"regexp_replace({_HTML}, '\s+', ' ', 'g')")


@query(f"SELECT page_id, length({_HTML}) AS n, md5({_HTML}) AS text_md5 FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-35: the text of a page."""
    p = table(spark, sf_dir, "pages").withColumn("x", t.html_text(F.col("html")))
    return p.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-42 D-18: content and row hashes."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md5"))


_FAM = {f: " + ".join(f"contains(lower(text), '{m.lower().replace(chr(39), chr(39) * 2)}')::INT" for m in ms) for f, ms in lex.FAMILIES.items()}


@query(f"""WITH {_HEUR}, c AS (SELECT doc_id, score AS s, greatest(len({WORDS}), 1) AS n, {", ".join(f"({e}) AS {f}" for f, e in _FAM.items())} FROM h),
r AS (SELECT doc_id, s, {", ".join(f"least({f} / (n / 100), 1) AS {f}" for f in _FAM)} FROM c),
q AS (SELECT *, greatest(gpt + claude + llama, 0.01) AS total, (1 - s) * (1 + human * 0.5) AS hp FROM r), ap AS (SELECT *, s * (1 - hp * 0.5) AS pool FROM q),
p AS (SELECT doc_id, s, hp, pool * (gpt / total) * 0.35 + pool * 0.3 AS g, pool * (claude / total) * 0.35 + pool * 0.2 AS c, pool * (llama / total) * 0.3 + pool * 0.2 AS l, pool * 0.1 AS o FROM ap),
f AS (SELECT doc_id, s, g / (g + c + l + hp + o) AS g, c / (g + c + l + hp + o) AS c, l / (g + c + l + hp + o) AS l, hp / (g + c + l + hp + o) AS h FROM p)
SELECT doc_id, CASE WHEN s < 0.4 THEN 0.02 ELSE round(g, 3) END AS gpt, CASE WHEN s < 0.4 THEN 0.02 ELSE round(c, 3) END AS claude, CASE WHEN s < 0.4 THEN 0.01 ELSE round(l, 3) END AS llama, CASE WHEN s < 0.4 THEN 0.93 ELSE round(h, 3) END AS human,
  CASE WHEN s < 0.4 THEN 'human' WHEN g >= c AND g >= l AND g >= h THEN 'gpt' WHEN c >= l AND c >= h THEN 'claude' WHEN l >= h THEN 'llama' ELSE 'human' END AS family FROM f""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-40 O-05 P-16: which family of writers a text is like."""
    d = _heuristic(_docs(spark, sf_dir))
    low, n, s = F.lower("text"), F.greatest(F.size(t.split_words(F.col("text"))), F.lit(1)), F.col("score")
    count = {f: sum((F.contains(low, F.lit(m.lower())).cast("int") for m in ms), F.lit(0)) for f, ms in lex.FAMILIES.items()}
    d = d.withColumns({f: F.least(c / (n / 100), F.lit(1.0)) for f, c in count.items()})
    d = d.withColumn("total", F.greatest(F.col("gpt") + F.col("claude") + F.col("llama"), F.lit(0.01))).withColumn("hp", (1 - s) * (1 + F.col("human") * 0.5)).withColumn("pool", s * (1 - F.col("hp") * 0.5))
    pool, total = F.col("pool"), F.col("total")
    d = d.select("doc_id", "score", F.col("hp").alias("h"), (pool * (F.col("gpt") / total) * 0.35 + pool * 0.3).alias("g"), (pool * (F.col("claude") / total) * 0.35 + pool * 0.2).alias("c"), (pool * (F.col("llama") / total) * 0.3 + pool * 0.2).alias("l"), (pool * 0.1).alias("o"))
    every = F.col("g") + F.col("c") + F.col("l") + F.col("h") + F.col("o")
    g, c, l, h = (F.col(k) / every for k in "gclh")
    human = F.col("score") < 0.4
    best = F.when(human, "human").when((g >= c) & (g >= l) & (g >= h), "gpt").when((c >= l) & (c >= h), "claude").when(l >= h, "llama").otherwise("human")
    pick = lambda v, x, name: F.when(human, v).otherwise(F.round(x, 3)).alias(name)
    return d.select("doc_id", pick(0.02, g, "gpt"), pick(0.02, c, "claude"), pick(0.01, l, "llama"), pick(0.93, h, "human"), best.alias("family"))


@query(r"""SELECT lang, count(*) AS n, round(avg(greatest(0.01, least(0.99, n_chars / 10000 + CASE lang WHEN 'en' THEN 0.0 WHEN 'de' THEN 0.02 WHEN 'fr' THEN 0.03 ELSE 0.05 END))), 6) AS mean_adjusted FROM documents GROUP BY lang""")
def language_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-50 J-09: a score moved by language, unknown ones by .05."""
    d = table(spark, sf_dir, "documents")
    known = F.create_map(*[F.lit(v) for kv in (("en", 0.0), ("de", 0.02), ("fr", 0.03)) for v in kv])
    adjusted = clip(F.col("n_chars") / 10000 + F.coalesce(F.try_element_at(known, F.col("lang")), F.lit(0.05)))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(adjusted)).alias("mean_adjusted"))


@query(rf"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(len(w), 1), 382)) AS start, w FROM w),
k AS (SELECT doc_id, start, len(list_slice(w, start + 1, start + 512)) AS n FROM c) SELECT doc_id, CAST(start AS INTEGER) AS start, n FROM k WHERE n >= 10""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-03: windows of 512 words, 382 apart; those under ten words go."""
    w = _docs(spark, sf_dir).withColumn("w", t.split_words(F.col("text")))
    c = w.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(382))))
    return c.select("doc_id", "start", F.greatest(F.lit(0), F.least(F.size("w") - F.col("start"), F.lit(512))).cast("long").alias("n")).where("n >= 10")


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w, {WORDS} AS o FROM documents),
l AS (SELECT doc_id, len(w) AS n, list_transform(o, lambda x: length(x)) AS ls, len(list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS d FROM w), m AS (SELECT *, list_sum(ls) / n AS mean FROM l)
SELECT doc_id, round(sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / n) / mean, 5) AS length_cv, round(d / greatest(n - 1, 1), 5) AS distinct_bigrams FROM m WHERE n > 0""")
def zero_shot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-28: variation of word length, share of distinct word pairs."""
    w = _docs(spark, sf_dir).select("doc_id", t.split_words(F.col("text")).alias("o"), t.split_words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("ls", F.transform("o", F.length)).withColumn("m", t.moments(F.col("ls")))
    m = F.col("m")
    pairs = F.when(F.size("w") > 1, F.size(F.array_distinct(t.bigrams(F.col("w"))))).otherwise(0)
    return w.select("doc_id", F.round(m["std"] / m["mean"], 5).alias("length_cv"), F.round(pairs / F.greatest(F.size("w") - 1, F.lit(1)), 5).alias("distinct_bigrams"))


_DEMO = rf"""b AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') AS w, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: length(x) > 5) AS s FROM documents),
l AS (SELECT *, len(w) AS n, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS ls, len(regexp_extract_all(text, '\b\w+''\w+\b')) AS short FROM b),
m AS (SELECT *, list_sum(ls) / len(ls) AS mean FROM l), c AS (SELECT *, CASE WHEN len(s) >= 3 AND mean > 0 THEN sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / len(ls)) / mean END AS cv, {_IN(lex.DEMO_HEDGES)} / nullif(n, 0) AS hr, {_IN(lex.DEMO_CASUALS)} / nullif(n, 0) AS cr, len(list_distinct(w)) / nullif(n, 0) AS ttr, short / nullif(n, 0) AS sr, {_IN(lex.FIRST_PERSON_WIDE)} / nullif(n, 0) AS fr FROM m),
g AS (SELECT doc_id, text, CASE WHEN cv IS NULL THEN 0.5 WHEN cv < 0.15 THEN 0.85 WHEN cv > 0.6 THEN 0.15 ELSE 0.85 - (cv - 0.15) * (0.7 / 0.45) END AS g1, CASE WHEN n < 10 THEN 0.5 WHEN hr > 0.04 THEN 0.9 WHEN hr > 0.02 THEN 0.7 ELSE greatest(0.1, 0.5 - hr * 10) END AS g2,
  CASE WHEN n < 10 THEN 0.5 WHEN cr > 0.03 THEN 0.1 WHEN cr > 0.01 THEN 0.3 ELSE 0.6 END AS g3, CASE WHEN n < 20 THEN 0.5 WHEN ttr < 0.4 THEN 0.75 WHEN ttr > 0.7 THEN 0.2 ELSE 0.75 - (ttr - 0.4) * (0.55 / 0.3) END AS g4,
  CASE WHEN n < 20 THEN 0.5 WHEN sr > 0.03 THEN 0.15 WHEN sr > 0.01 THEN 0.35 ELSE 0.7 END AS g5, CASE WHEN n < 20 THEN 0.5 WHEN fr > 0.04 THEN 0.15 WHEN fr > 0.02 THEN 0.35 ELSE 0.65 END AS g6 FROM c),
d AS (SELECT doc_id, CASE WHEN length({STRIP.format('text')}) < 40 THEN 0.5 ELSE (g1 * 1.5 + g2 * 2.5 + g3 + g4 * 0.5 + g5 * 2 + g6 * 2)::DOUBLE / 9.5 END AS score FROM g)"""


@query(f"WITH {_DEMO} SELECT doc_id, round(score, 9) AS score, CASE WHEN score > 0.55 THEN 'AI_GENERATED' WHEN score < 0.4 THEN 'HUMAN' ELSE 'UNCERTAIN' END AS label FROM d")
def demo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-26: six piecewise signals; texts under 40 characters are UNCERTAIN."""
    x = F.col("text")
    parts = F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), t.strip), lambda s: F.length(s) > 5)
    d = _docs(spark, sf_dir).withColumn("w", F.regexp_extract_all(F.lower(x), F.lit("[a-z']+"), F.lit(0))).withColumn("ls", F.transform(parts, lambda s: F.size(t.split_words(s)))).withColumn("m", t.moments(F.col("ls")))
    n, m = F.size("w"), F.col("m")
    rate = lambda c: F.try_divide(c, n)
    cv, hedge, casual = F.try_divide(m["std"], m["mean"]), rate(t.among(F.col("w"), lex.DEMO_HEDGES)), rate(t.among(F.col("w"), lex.DEMO_CASUALS))
    ttr, short, first = rate(F.size(F.array_distinct("w"))), rate(F.size(F.regexp_extract_all(x, F.lit(r"\b\w+'\w+\b"), F.lit(0)))), rate(t.among(F.col("w"), lex.FIRST_PERSON_WIDE))
    signals = [
        (1.5, F.when((F.size("ls") < 3) | cv.isNull(), 0.5).when(cv < 0.15, 0.85).when(cv > 0.6, 0.15).otherwise(0.85 - (cv - 0.15) * (0.7 / 0.45))),
        (2.5, F.when(n < 10, 0.5).when(hedge > 0.04, 0.9).when(hedge > 0.02, 0.7).otherwise(F.greatest(F.lit(0.1), 0.5 - hedge * 10))),
        (1.0, F.when(n < 10, 0.5).when(casual > 0.03, 0.1).when(casual > 0.01, 0.3).otherwise(0.6)),
        (0.5, F.when(n < 20, 0.5).when(ttr < 0.4, 0.75).when(ttr > 0.7, 0.2).otherwise(0.75 - (ttr - 0.4) * (0.55 / 0.3))),
        (2.0, F.when(n < 20, 0.5).when(short > 0.03, 0.15).when(short > 0.01, 0.35).otherwise(0.7)),
        (2.0, F.when(n < 20, 0.5).when(first > 0.04, 0.15).when(first > 0.02, 0.35).otherwise(0.65)),
    ]
    score = F.when(F.length(t.strip(x)) < 40, 0.5).otherwise(sum((s * w for w, s in signals), F.lit(0.0)) / 9.5)
    d = d.withColumn("score", score)
    label = F.when(F.col("score") > 0.55, "AI_GENERATED").when(F.col("score") < 0.4, "HUMAN").otherwise("UNCERTAIN")
    return d.select("doc_id", F.round("score", 9).alias("score"), label.alias("label"))


@query(rf"""WITH {_HEUR}, k AS (SELECT doc_id, score, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w, {sents(4)} AS s FROM h),
r AS (SELECT doc_id, score, len(list_filter(range(2, len(w) + 1), lambda i: list_contains({_list(lex.AUXILIARIES)}, w[i - 1]) AND ends_with(w[i], 'ed'))) / greatest(len(w), 1) AS passive, len(list_filter(s, lambda x: regexp_matches(lower(x), '^({"|".join(lex.OPENINGS)})'))) / greatest(len(s), 1) AS coord FROM k)
SELECT doc_id, round(passive, 9) AS passive_rate, round(coord, 9) AS coord_start_rate, round(least(0.99, score + (passive * 0.5 + coord * 0.3) * (1 - score)), 9) AS adjusted FROM r""")
def back_translation_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-27: passive pairs and coordinating openings, which move the score up."""
    d = _heuristic(_docs(spark, sf_dir)).select("doc_id", "score", t.split_words(F.lower("text")).alias("w"), t.sentences(F.col("text"), 4).alias("s"))
    passive = F.size(F.filter("w", lambda x, i: (i > 0) & x.endswith("ed") & F.coalesce(F.get("w", i - 1).isin(lex.AUXILIARIES), F.lit(False))))
    coord = F.size(F.filter("s", lambda x: F.lower(x).rlike(f"^({'|'.join(lex.OPENINGS)})")))
    d = d.select("doc_id", "score", (passive / F.greatest(F.size("w"), F.lit(1))).alias("p"), (coord / F.greatest(F.size("s"), F.lit(1))).alias("c"))
    adjusted = F.least(F.lit(0.99), F.col("score") + (F.col("p") * 0.5 + F.col("c") * 0.3) * (1 - F.col("score")))
    return d.select("doc_id", F.round("p", 9).alias("passive_rate"), F.round("c", 9).alias("coord_start_rate"), F.round(adjusted, 9).alias("adjusted"))


_SWAPPED = "CASE regexp_replace(lower(w), '[.,;:]+$', '') " + " ".join(f"WHEN '{a}' THEN replace(w, '{a}', '{b}')" for a, b in attacks.SYNONYMS.items()) + " ELSE w END"
_GLYPHED = f"CASE WHEN lower(w) IN ({', '.join(repr(g) for g in attacks.GLYPHS)}) THEN translate(lower(w), '{''.join(attacks.GLYPHS)}', '{''.join(attacks.GLYPHS.values())}') ELSE w END"
_BARE = r"list_filter(regexp_split_to_array({}, '\s+'), lambda y: y <> '')"
_SHUFFLED = f"array_to_string(list_transform(list_sort(list_transform({_BARE.format('w')}, lambda v, j: {{'o': md5((j - 1) || ':' || v), 'w': v}})), lambda z: z.w), ' ')"
#: Parts of a text, how many of them are drawn for an amount, what becomes of a part, and what joins them.
_HOW = {
    "shuffle": ("string_split(text, '. ')", "{}", _SHUFFLED, ". "), "synonym": (_BARE.format("text"), "m * {} // 100", _SWAPPED, " "),
    "zwsp": ("string_split(text, '')", "m * {} // 100", f"'{attacks.BLANK}' || w", ""), "homoglyph": ("string_split(text, '')", "greatest(1, m * {} // 100)", _GLYPHED, ""),
}
_H = f"((i - 1 + m) * {attacks.TIMES} % {attacks.MODULUS})"
_ATTACKED = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS attack, '{s}' AS strength, array_to_string(list_transform(p, lambda w, i: CASE WHEN {_H} <= last THEN {change} ELSE w END), '{glue}') AS x
  FROM (SELECT doc_id, p, m, CASE WHEN n > 0 THEN list_sort(list_transform(range(1, m + 1), lambda i: {_H}))[least(n, m)] END AS last FROM (SELECT doc_id, p, m, {n.format(v)} AS n FROM (SELECT doc_id, p, len(p) AS m FROM (SELECT doc_id, {parts} AS p FROM victims))))"""
    for k, (parts, n, change, glue) in _HOW.items() for s, v in attacks.STRENGTHS[k].items()
)


@query(f"WITH victims AS (SELECT doc_id, text FROM documents), a AS ({_ATTACKED}) SELECT doc_id, attack, strength, md5(x) AS attacked_md5 FROM a")
def attacked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-48: each text under each attack of each strength, as a hash."""
    out = attacks.attacked(_docs(spark, sf_dir))
    return out.select("doc_id", "attack", "strength", F.md5(F.col("text").cast("binary")).alias("attacked_md5"))


_LEAST_RATES = ", ".join(f"('{k}', {v})" for k, v in attacks.CRITERIA.items())


@query(f"""WITH victims AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL), a AS ({_ATTACKED} UNION ALL SELECT doc_id, 'none', 'none', text FROM victims),
k AS (SELECT row_number() OVER () AS key, * FROM a), d AS (SELECT key AS doc_id, x AS text FROM k), {_STYLE.replace("FROM documents", "FROM d")},
s AS (SELECT k.doc_id, attack, strength, CAST(score AS DOUBLE) AS score FROM k JOIN scored ON scored.doc_id = key),
g AS (SELECT h.attack, h.strength, avg(b.score) AS baseline, avg(h.score) AS attacked, avg((h.score >= 0.5)::INT) AS rate FROM s h JOIN s b ON b.doc_id = h.doc_id AND b.attack = 'none' WHERE h.attack <> 'none' GROUP BY 1, 2),
r AS (SELECT g.*, rate >= c.least AS passed FROM g JOIN (VALUES {_LEAST_RATES}) c(attack, least) USING (attack))
SELECT attack, strength, round(baseline, 6) AS baseline, round(attacked, 6) AS attacked, round(baseline - attacked, 6) AS score_drop, round(rate, 6) AS detection_rate, passed,
  round(avg(passed::INT) OVER (), 6) AS pass_rate, first(attack) OVER (ORDER BY rate, attack, strength) || ':' || first(strength) OVER (ORDER BY rate, attack, strength) AS weakest FROM r""")
def attack_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: good documents attacked, scored again and held against their own score; the share of attacks that pass, and the weakest."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    d = _docs(spark, sf_dir).where("text is not null").join(good, "doc_id").select("doc_id", "text")
    hit = t.stylometry(attacks.attacked(d)).select("doc_id", "attack", "strength", "score")
    base = t.stylometry(d).select("doc_id", F.col("score").alias("own"))
    rate = F.avg((F.col("score") >= 0.5).cast("int"))
    g = hit.join(base, "doc_id").groupBy("attack", "strength").agg(F.avg("own").alias("baseline"), F.avg("score").alias("attacked"), rate.alias("rate"))
    least = F.create_map(*[F.lit(x) for kv in attacks.CRITERIA.items() for x in kv])
    g = g.withColumn("passed", F.col("rate") >= F.element_at(least, F.col("attack")))
    total = g.agg(F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.min_by(F.concat_ws(":", "attack", "strength"), F.struct("rate", "attack", "strength")).alias("weakest"))  # one row
    return g.crossJoin(F.broadcast(total)).select(
        "attack", "strength", r6("baseline").alias("baseline"), r6("attacked").alias("attacked"), r6(F.col("baseline") - F.col("attacked")).alias("score_drop"),
        r6("rate").alias("detection_rate"), "passed", r6("pass_rate").alias("pass_rate"), "weakest",
    )


_NAMES = r"list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*')))"
_STYLES = {"snake": "^[a-z0-9]+(_[a-z0-9]+)+$", "camel": "^[a-z]+([A-Z][a-z0-9]*)+$", "short": "^.{1,4}$", "digits": "[0-9]", "single": "^.$"}


@query(f"""WITH n AS (SELECT doc_id, {_NAMES} AS names FROM documents)
SELECT doc_id, len(names) AS n_names, {", ".join(f"round(coalesce(len(list_filter(names, lambda x: regexp_matches(x, '{p}'))) / nullif(len(names), 0), 0), 6) AS {k}" for k, p in _STYLES.items())} FROM n""")
def naming_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-08: distinct names of a source text and the shares of their styles."""
    d = _docs(spark, sf_dir).withColumn("names", udfs.identifiers(F.col("text")))
    return d.select("doc_id", F.size("names").cast("long").alias("n_names"), *[F.round(c, 6).alias(k) for k, c in udfs.naming_of(F.col("names")).items()])


@query(r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '[ \t]*#[^\n]*', '', 'g') AS bare FROM documents)
SELECT doc_id, length(text) - length(bare) AS dropped, md5(bare) AS bare_md5 FROM c""")
def bare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10 (comments only): source texts without comments to the end of a line."""
    bare = udfs.strip_comments(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", (F.length("text") - F.length(bare)).cast("long").alias("dropped"), F.md5(bare.cast("binary")).alias("bare_md5"))
