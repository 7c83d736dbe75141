"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.llm import decontamination, fingerprints, language, lines, mixing, neighbours, pieces, prefixes, quality, secret_scan, sharding, simhash, whitening
from contentlens.llm.common import held_out, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.predict(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.MARK, " "))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.RULES if r.base]
    base = F.filter(found, lambda x: x["kind"].isin(kinds))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    many = [F.size(F.filter(found, _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return out.select("doc_id", *many, F.sha2(text(base), 256).alias("base_sha256"), text(found).alias("spans"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 16)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=4)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    rebuilt = prefixes.shared_heads(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)
    return prefixes.trie(rebuilt, turns.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_quality_classifier, op3_language_id, op4_sentencepiece, op5_simhash_near_dedup,
        op6_nearest_neighbours, op7_secret_scan, op8_order_minhash, op9_sharding, op10_source_mixing,
        op11_embedding_whitening, op12_decontamination, op13_prefix_trie,
    )
}

#: Exact distinct counts stand for the sketches: near the threshold the operator counts exactly too.
ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH shown AS (
  SELECT d.doc_id, coalesce(d.source, chr(0)) AS site, s.i AS place, string_split(d.text, chr(10))[s.i] AS line
  FROM documents d, LATERAL (SELECT unnest(generate_series(1, len(string_split(d.text, chr(10))))) AS i) s
  WHERE d.text IS NOT NULL),
bad AS (
  SELECT line, min((doc_id, place)) AS first FROM shown
  WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
marked AS (
  SELECT s.doc_id, s.place, s.line, (b.line IS NOT NULL AND (s.doc_id, s.place) <> b.first) AS gone
  FROM shown s LEFT JOIN bad b ON s.line = b.line),
built AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone) AS text,
         count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(n_removed AS INTEGER) AS n_removed, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
       sha256(coalesce(text, '')) AS text_sha256
FROM built""",
    # null, zero and non-finite vectors take no part; ids are unique here
    "op6_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op12_decontamination": r"""
WITH iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[s.i + 1 : s.i + 10], ' ') AS w
  FROM iw, LATERAL (SELECT unnest(generate_series(0, greatest(len(ws) - 10, 0))) AS i) s WHERE len(ws) > 0),
dw AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
runs AS (
  SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM win))),
hits AS (SELECT r.doc_id, r.i, r.m, w.item FROM runs r JOIN win w USING (w)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY doc_id),
having_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(h.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(h.items, '')) AS items_sha256, coalesce(s.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN spots s USING (doc_id) LEFT JOIN having_items h USING (doc_id)""",
    # a prefix is the list of its turns; CRC-32 is reckoned bit by bit
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS b, (xor(4294967295, list_reduce(
      flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)))) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)),
lent AS (SELECT i.c, o.p AS d, o.role, o.text FROM ids i JOIN own o ON o.c = i.b AND o.p <= i.h),
given AS (SELECT i.c, i.h, count(l.d) AS n FROM ids i LEFT JOIN lent l USING (c) GROUP BY ALL),
turns AS (
  SELECT * FROM lent
  UNION ALL SELECT o.c, o.p - g.h + g.n, o.role, o.text FROM own o JOIN given g USING (c) WHERE o.p > g.h),
paths AS (
  SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS prefix FROM turns
  UNION ALL SELECT c, 0, '', [] FROM ids),
nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS words
  FROM paths GROUP BY d, prefix),
of AS (SELECT p.c, p.d, n.conv_id FROM paths p JOIN nodes n ON n.d = p.d AND n.prefix = p.prefix),
tree AS (
  SELECT n.conv_id, n.d, n.n_convs, n.words, o.conv_id AS parent
  FROM nodes n LEFT JOIN of o ON o.c = n.conv_id AND o.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM tree WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.conv_id, a.d, sum((t.n_convs - 1) * t.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM tree t JOIN of a ON a.c = t.conv_id AND a.d <= t.d LEFT JOIN kids k ON k.conv_id = t.conv_id AND k.d = t.d GROUP BY ALL),
ends AS (
  SELECT o.conv_id, o.d, string_agg(CAST(o.c AS VARCHAR), ',' ORDER BY o.c) AS ids
  FROM of o JOIN (SELECT c, max(d) AS d FROM paths GROUP BY c) l USING (c, d) GROUP BY ALL)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, t.parent AS parent_conv_id, t.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t LEFT JOIN kids k USING (conv_id, d) JOIN below b USING (conv_id, d) LEFT JOIN ends e USING (conv_id, d)""",
}
