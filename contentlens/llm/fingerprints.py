"""Order MinHash document fingerprints (DataFrame functions only).

The k-mers of a text are its runs of two words, numbered by occurrence, so
repeats count.  Each numbered k-mer has one hash; its top bits choose one of
``BINS`` bins (one-permutation hashing stands for as many hash functions).  In
each bin the ``PICK`` least are selected, put back in text order and hashed as a
tuple: a signature that changes with what a text holds and with its order, as
edit distance does.  Likeness is the share of bins, used by either text, whose
tuples agree.

All work on a text happens within its row, on arrays of longs: no k-mer is
exploded or shuffled, and memory is bounded by the longest text.

Defined cases: a null text counts as empty; a text without words has an empty
fingerprint, which is 1.0 like another empty one and 0.0 like any other; a text
of one word is one k-mer; repeated rows (same id and text) count
once in the order of documents and each get the same result; null ids sort
after all others, by a hash of their text; a lone document is its own
neighbour; ids that are no whole numbers are an error; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from contentlens.llm.common import free

BIN_BITS, PICK = 6, 2
#: Documents in a bucket of neighbouring ids, for tables below some tens of millions of them; beyond, a quarter of the root of their number.
BUCKET = 2000
#: Low bits that hold a k-mer's place, enough for the longest text that Spark holds; the others order it.
_PLACES = 30
_PLACE = (1 << _PLACES) - 1
_SHIFT = 64 - BIN_BITS


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(at)


def signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add a column of sorted longs: bin (high) and tuple hash (26 bits) for each bin in use."""
    w, h, s, r, z, kept = (free(df, f"__{c}") for c in ("words", "kmers", "sorted", "runs", "ranked", "kept"))
    no_words = F.array().cast("array<string>")
    ws = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(w, F.transform(F.coalesce(ws, no_words), lambda x: F.xxhash64(x)))
    # get() past the end gives null, which the hash leaves out: one k-mer for a short text
    kmers = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    df = df.withColumn(h, F.slice(kmers, 1, F.greatest(F.size(w) - 1, F.least(F.size(w), F.lit(1)))))
    places = F.transform(h, lambda x, i: _packed(x, i.cast("long")))
    df = df.withColumn(s, F.sort_array(places))
    # equal k-mers are neighbours now: where runs of them start (null if there is none to number)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.shiftright(F.get(s, i), _PLACES) != F.shiftright(F.get(s, i - 1), _PLACES)))
    df = df.withColumn(r, F.when((F.size(s) > 0) & (F.size(F.array_distinct(h)) < F.size(h)), starts))

    def numbered(start: Column, j: Column) -> Column:
        run = F.slice(s, start + 1, F.coalesce(F.get(r, j + 1), F.size(s)) - start)
        return F.transform(run, lambda x, k: F.when(k == 0, x).otherwise(_packed(F.xxhash64(F.shiftright(x, _PLACES), k), x.bitwiseAND(F.lit(_PLACE)))))

    df = df.withColumn(z, F.when(F.col(r).isNull(), F.col(s)).otherwise(F.sort_array(F.flatten(F.transform(r, numbered)))))
    df = df.withColumn(kept, F.filter(z, lambda x, i: F.coalesce(_bin(F.get(z, i - PICK)) != _bin(x), F.lit(True))))

    def at(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_PLACE)).cast("int")

    def tuple_hash(x: Column, i: Column) -> Column:
        y = F.get(kept, i + 1)
        y = F.when(_bin(y) == _bin(x), y)
        a, b = F.least(at(x), at(y)), F.greatest(at(x), at(y))  # least and greatest skip nulls
        pair = F.when(y.isNull(), F.xxhash64(F.get(h, at(x)))).otherwise(F.xxhash64(F.get(h, a), F.get(h, b)))
        first = F.coalesce(_bin(F.get(kept, i - 1)) != _bin(x), F.lit(True))
        return F.when(first, F.shiftrightunsigned(x, _SHIFT) * F.lit(1 << 26).cast("long") + F.shiftrightunsigned(pair, 38))

    sig = F.sort_array(F.array_compact(F.transform(kept, tuple_hash)))
    return df.withColumn(out, sig).drop(w, h, s, r, z, kept)


def as_text(sig: Column) -> Column:
    """Eight hex digits for each bin in use."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins in use by either fingerprint whose tuples agree."""
    used = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 26)), F.transform(b, lambda x: F.shiftright(x, 26))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _doubles(values: list[float]) -> Column:
    """An array as one constant, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if values else F.array().cast("array<double>")


def bounds(documents: DataFrame) -> tuple[list[float], list[float], Column]:
    """What cuts the documents into buckets of about as many: ids in descending order; for those with a null id, text hashes in ascending
    order, both as doubles, which keep the order; and what tells the first rows of all.  From ids and hashes alone."""
    n, nulls, top, least = documents.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.max("doc_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("t")))).first()
    size = max(BUCKET, math.isqrt(n) // 4)

    def cuts(of: str, rows: int, where: Column) -> set[float]:
        many = rows // size
        if many < 2:
            return set()
        share = _doubles([i / many for i in range(1, many)])
        return set(documents.where(where).agg(F.percentile_approx(F.col(of).cast("double"), share, F.lit(max(20_000, 4 * many)))).first()[0])

    ids = cuts("doc_id", n - nulls, F.col("doc_id").isNotNull()) - ({float(top)} if top is not None else set())
    hashes = cuts("t", nulls, F.col("doc_id").isNull()) - ({float(least)} if least is not None else set())
    start = F.col("doc_id") == F.lit(top) if top is not None else F.col("t") == F.lit(least)
    return sorted(ids, reverse=True), sorted(hashes), start


def _passed(cuts: Column, many: int, passed) -> Column:
    """How many of the sorted cuts a row has passed, by bisection."""
    if not many:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(many.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(passed(F.get(cuts, at + step - 1)), F.lit(False)), at + step).otherwise(at))


def with_next(documents: DataFrame) -> DataFrame:
    """Adds next: the following document by descending id, in a ring, as a struct of ``documents``'s columns.

    Input: doc_id, t (a hash of the text) and any more.  One shuffle: rows go to
    the bucket of their id, or of their hash where the id is null, and the rows at
    a bucket's start also visit the bucket before it, where they follow its last.
    Equal rows count once.
    """
    ids, hashes, start = bounds(documents)
    id_cuts, t_cuts, null, home = _doubles(ids), _doubles(hashes), F.col("doc_id").isNull(), F.col("home")
    doc_id, t = F.col("doc_id").cast("double"), F.col("t").cast("double")
    by_id, by_hash = _passed(id_cuts, len(ids), lambda c: doc_id <= c), _passed(t_cuts, len(hashes), lambda c: t >= c)
    rows = documents.withColumn("home", F.when(null, len(ids) + by_hash).otherwise(by_id))
    at_cut = F.when(null, F.get(t_cuts, home - len(ids) - 1) == t).otherwise(F.get(id_cuts, home - 1) == doc_id)
    first = F.coalesce(at_cut, F.lit(False)) | F.coalesce(start, F.lit(False))
    before = F.when(home == 0, len(ids) + len(hashes)).otherwise(home - 1)
    own = F.struct(home.alias("bucket"), F.lit(False).alias("guest"))
    visits = F.when(first, F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    me = F.struct(*documents.columns)
    rows = rows.withColumn("at", F.explode(visits)).select(*documents.columns, "at.bucket", "at.guest")
    place = F.dense_rank().over(W.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "t"))
    rows = rows.withColumn("place", place)
    following = F.first(me).over(W.partitionBy("bucket").orderBy("place").rangeBetween(1, 1))
    return rows.withColumn("next", following).where(~F.col("guest")).drop("bucket", "guest", "place")


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    if not isinstance(documents.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    rows = with_next(signature(docs, "text", "sig"))
    n = F.length("text")
    edited = F.expr("concat(substring(text, 1, cast(length(text) - length(text) div 2 as int)), substring(next.text, 1, cast(length(text) div 2 as int)))")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", F.col("next.sig").alias("next_sig"), edited.alias("edited"))
    rows = signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
