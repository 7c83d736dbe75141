"""Two series of scores held in step: resampling and correlation within the row, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS, LEAST = 20, 3


def resampled(values: Column, n: Column) -> Column:
    """n points of a series by linear interpolation, its ends included; n is at least 2."""

    def point(i: Column) -> Column:
        at = i.cast("double") * (F.size(values) - 1) / (n - 1)
        lo = F.floor(at).cast("int")
        left = F.get(values, lo)
        return left + (at - lo) * (F.coalesce(F.get(values, lo + 1), left) - left)

    return F.transform(F.sequence(F.lit(0), n - 1), point)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def centred(values: Column) -> Column:
    return F.transform(values, lambda v: v - _mean(values))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length, held within -1 and 1; 0 if either is flat."""
    x, y = centred(a), centred(b)
    flat = (F.array_max(a) == F.array_min(a)) | (F.array_max(b) == F.array_min(b))
    r = F.try_divide(_dot(x, y), F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)))
    return F.when(flat, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))))


def alignment(video: Column, audio: Column) -> dict[str, Column]:
    """points, consistency, mismatch, severity, correlation and gap of two arrays of doubles.

    With fewer than LEAST values in either (or a null array) there is nothing to compare: consistency .5, no mismatch.
    """
    enough = F.coalesce((F.size(video) >= LEAST) & (F.size(audio) >= LEAST), F.lit(False))
    n = F.least(F.size(video), F.size(audio), F.lit(POINTS))
    v, a = resampled(video, n), resampled(audio, n)
    r, gap = pearson(v, a), F.abs(_mean(v) - _mean(a))
    severity = F.when(gap > 0.50, "high").when(gap > 0.30, "medium").when(gap > 0.15, "low").otherwise("none")
    return {
        "points": F.when(enough, n).otherwise(0), "consistency": F.when(enough, (r + 1) / 2 * (1 - F.least(gap, F.lit(1.0)))).otherwise(0.5),
        "mismatch": F.when(enough, (gap > 0.30) & (r < 0.3)).otherwise(False), "severity": F.when(enough, severity).otherwise("none"),
        "correlation": F.when(enough, r), "gap": F.when(enough, gap),
    }
