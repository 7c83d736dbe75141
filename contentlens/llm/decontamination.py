"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is ``WINDOW`` consecutive words of a benchmark item (all words of a
shorter one).  Its tokens are its shingles of ``SHINGLE`` words (of all its
words, if fewer), ordered by rarity: by how often the documents show them.  A
document that holds a window holds all its tokens, so at this containment the
prefix of necessary tokens is one, the rarest:

1. documents become blocks of ``BLOCK`` words, which overlap by a window less a
   word, so that no row holds more than that; in each, the positions of shingles
   that items may have are kept (by a Bloom filter of at most 2**21 bits, which
   lets other shingles pass now and then but never loses one);
2. the kept positions are counted by shingle, and each window takes its rarest;
3. positions of these are joined with (shingle, offset in the window, length of the window);
   what would start before its block or end after the document goes;
4. the words there are compared with the windows' own, by an equality join.

Tables between the steps are written to the shared folder.  A frequent passage
is a large key on the documents' side of joins, which AQE splits; the other
side has a row for each window or shingle.

Defined cases: null and empty texts have no words; a null item_id counts as the
id ''; rows of one item_id are one item with the windows of all; repeated items
all count; repeated documents, and those with a null id, each get their own row;
without items nothing is hit; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import materialise

WINDOW, SHINGLE, BLOCK = 10, 3, 4096
#: Bits of the filter for each shingle of the items, bits tested for each, and log2 of its least and largest size.
BITS, PROBES, LEAST, MOST = 32, 3, 12, 21
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _APART), "")


def _shingle(ws: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + k) for k in range(length)], F.lit(length))


def windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """w (the words of a window, joined by spaces) and the item that has it; distinct."""
    ws = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    return ws.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("ws", i + 1, window), " "))).alias("w")).distinct()


def _tokens(ws: DataFrame, shingle: int) -> DataFrame:
    """w, length of the window, and each of its shingles: hash h, offset o, length of the shingle."""
    ws = ws.withColumn("ws", F.split("w", " ")).withColumn("m", F.size("ws"))
    last = F.col("m") - F.least("m", F.lit(shingle))
    hashed = lambda i: F.coalesce(*[F.when(F.least("m", F.lit(shingle)) == q, _shingle(F.col("ws"), i, q)) for q in range(1, shingle + 1)])
    each = F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("o"), hashed(i).alias("h"))))
    return ws.withColumn("t", each).select("w", "m", F.least("m", F.lit(shingle)).alias("q"), "t.o", "t.h")


def _probe(h: Column, j: int, size: int) -> Column:
    return F.shiftrightunsigned(h, MOST * j).bitwiseAND(F.lit((1 << size) - 1))


class Filter:
    """A Bloom filter of hashes as one constant of the plan; its longs (32,768 at most) are gathered by the driver."""

    def __init__(self, hashes: DataFrame):
        many = hashes.count()
        self.size = min(MOST, max(LEAST, (many * BITS).bit_length()))
        bits = hashes.select(F.explode(F.array(*[_probe(F.col("h"), j, self.size) for j in range(PROBES)])).alias("p"))
        rows = bits.groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("x"))
        longs = [0] * (1 << self.size - 6)
        for r in rows.collect():
            longs[r["at"]] = r["x"]
        self.longs = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<long>")

    def may_hold(self, h: Column) -> Column:
        out = F.lit(True)
        for j in range(PROBES):
            p = _probe(h, j, self.size)
            held = F.get(self.longs, F.shiftright(p, 6).cast("int"))
            out &= F.call_function("getbit", held, p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return out


FOUND = "array<struct<h:bigint,i:int>>"


def _positions(length: int) -> tuple[Column, Column]:
    """The hashes of a block's shingles of this length, and the places where they start."""
    hashes = F.transform("ws", lambda _, i: _shingle(F.col("ws"), i, length))
    return hashes, F.when(F.size("ws") >= length, F.sequence(F.lit(0), F.size("ws") - length))


def _kept(hashes: Column, places: Column, known: Filter) -> Column:
    kept = F.filter(places, lambda i: known.may_hold(F.get(hashes, i)))
    return F.transform(kept, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))


def _blocks(documents: DataFrame, lengths: list[int], known: Filter, window: int, block: int, doc_id: str, text: str) -> DataFrame:
    """row, id, n_words, block, its words where some shingle may be known, and found: (shingle, place in the block) of these."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), words(F.col(text)).alias("all"))
    docs = docs.withColumn("n_words", F.size("all"))
    part = lambda s: F.struct((s / block).cast("int").alias("block"), F.slice("all", s + 1, block + window - 1).alias("ws"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(block))
    rows = docs.select("row", "id", "n_words", F.explode(F.transform(starts, part)).alias("part")).select("row", "id", "n_words", "part.block", "part.ws")
    found = []
    for q in lengths:
        hashes, places = _positions(q)
        rows = rows.withColumn(f"h{q}", hashes)
        found.append(F.coalesce(_kept(F.col(f"h{q}"), places, known), F.array().cast(FOUND)))
    rows = rows.withColumn("found", F.concat(*found) if found else F.array().cast(FOUND))
    return rows.select("row", "id", "n_words", "block", F.when(F.size("found") > 0, F.col("ws")).alias("ws"), "found")


def matches(blocks: DataFrame, tokens: DataFrame, window: int, block: int) -> DataFrame:
    """row, start, m, w: every occurrence of a window."""
    seen = blocks.select(F.explode("found").alias("f"), "block").where(F.col("f.i") < block).groupBy("f.h").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(seen, "h").groupBy("w", "m", "q").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("n", "h", "o")).alias("least"))
    # a window of which some token shows up nowhere is nowhere either
    prefix = materialise(rare.where(F.col("there") == F.col("m") - F.col("q") + 1).select("w", "m", "least.h", "least.o"))
    at = F.col("f.i")
    first = F.greatest(at - (window - 1), F.lit(0))
    around = blocks.where(F.size("found") > 0).select("row", "n_words", "block", "ws", F.explode("found").alias("f"))
    around = around.select("row", "n_words", "block", F.col("f.h").alias("h"), at.alias("i"), first.alias("from"), F.slice("ws", first + 1, 2 * window - 1).alias("near"))
    start = F.col("i") - F.col("o")
    cands = around.join(prefix.select("h", "o", "m").distinct(), "h").where((start >= 0) & (start < block) & (F.col("block") * block + start + F.col("m") <= F.col("n_words")))
    # greatest(): the optimiser may take the words before it drops starts below 0
    there = F.array_join(F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("m")), " ")
    cands = cands.select("row", (F.col("block") * block + start).alias("start"), "h", "o", "m", there.alias("w"))
    return cands.join(prefix, ["w", "h", "o", "m"], "left_semi").select("row", "start", "m", "w")


def _covered(spans: Column) -> Column:
    """How many places the (start, m) spans cover together."""

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["m"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc["n"])


def contaminated(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row for each document: its id, n_words, n_hit (words inside windows of items), items (the sorted ids of these, as text), spans (start, m)."""
    shingle = min(shingle, window)
    members = materialise(windows(items, window, item_id, item_text))
    tokens = materialise(_tokens(members.select("w").distinct(), shingle))
    lengths = sorted(r.q for r in tokens.select("q").distinct().collect())  # `shingle` of them at most
    blocks = materialise(_blocks(documents, lengths, Filter(tokens.select("h").distinct()), window, block, doc_id, text))
    hits = materialise(matches(blocks, tokens, window, block))
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "m")).alias("spans"))
    having = hits.select("row", "w").distinct().join(members, "w").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = blocks.where("block = 0").select("row", F.col("id").alias(doc_id), "n_words")
    out = base.join(spans, "row", "left").join(having, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        doc_id, F.col("n_words").cast("long").alias("n_words"), F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce(F.sort_array("spans"), F.array().cast("array<struct<start:int,m:int>>")).alias("spans"),
    )
