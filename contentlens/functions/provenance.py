"""Signed passports of contents, and marks of provenance in their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.functions.signing import sign

# Byte strings that a provenance manifest leaves in a file.
MANIFEST_MARKS = ["c2pa", "jumb", "urn:uuid", "contentauth"]


def byte_marks(data: Column) -> Column:
    """The marks that a file's bytes hold.  Built-ins only."""
    return F.array_compact(F.array(*[F.when(F.contains(data, F.lit(m.encode())), m) for m in MANIFEST_MARKS]))


def canonical(**fields: Column) -> Column:
    """JSON of the fields, keys in order, so that equal contents sign alike."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def issue(df: DataFrame, content: Column, issuer: str, key: str, **claims: Column) -> DataFrame:
    """Adds passport: content hash, payload and signature."""
    payload = canonical(content_sha256=F.sha2(content, 256), issuer=F.lit(issuer), **claims)
    signed = df.withColumn("__payload", payload).withColumn("__signature", sign(F.col("__payload"), key))
    return signed.withColumn("passport", F.struct(F.sha2(content, 256).alias("content_sha256"), F.col("__payload").alias("payload"), F.col("__signature").alias("signature"))).drop("__payload", "__signature")


def verify(df: DataFrame, content: Column, key: str, passport: str = "passport") -> DataFrame:
    """Adds verdict: valid, changed (the content differs), forged (the signature does), or missing."""
    p = F.col(passport)
    good = df.withColumn("__expected", sign(p["payload"], key))
    same = F.get_json_object(p["payload"], "$.content_sha256") == F.sha2(content, 256)
    verdict = F.when(p.isNull() | p["payload"].isNull(), "missing").when(F.col("__expected") != p["signature"], "forged").when(~same, "changed").otherwise("valid")
    return good.withColumn("verdict", verdict).drop("__expected")
