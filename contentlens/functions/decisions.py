"""Label policies, zones and other decision functions, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """AI at or above (over, if strict) ``ai``; HUMAN at or below (under) ``human``; else UNCERTAIN."""

    ai: float
    human: float
    strict: bool = False


# Fixed values
POLICIES = {
    "detector": Policy(0.70, 0.30),
    "engine": Policy(0.75, 0.40),
    "fallback": Policy(0.55, 0.40, True),
    "sentence": Policy(0.60, 0.40, True),
    "two_layers": Policy(0.55, 0.30),
    "three_layers": Policy(0.65, 0.35),
    "four_layers": Policy(0.75, 0.40),
}


def label_zone(score: Column, policy: Policy | str) -> Column:
    p = POLICIES[policy] if isinstance(policy, str) else policy
    ai, human = (score > p.ai, score < p.human) if p.strict else (score >= p.ai, score <= p.human)
    return F.when(ai, "AI").when(human, "HUMAN").otherwise("UNCERTAIN")


def clip(c: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def psi_class(psi: Column) -> Column:
    return F.when(psi < 0.10, "STABLE").when(psi < 0.25, "MODERATE").when(psi.isNotNull(), "SIGNIFICANT")


def trust_state(coverage: Column, reliability: Column, psi: Column) -> Column:
    """gray without a reliability; an unknown psi can be orange at best."""
    green = (coverage >= 0.60) & (reliability >= 0.90) & (psi < 0.10)
    orange = (coverage >= 0.40) & (reliability >= 0.70) & (psi.isNull() | (psi < 0.25))
    return F.when(reliability.isNull(), "gray").when(green, "green").when(orange, "orange").otherwise("red")


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "high").otherwise("medium")


def normal_upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def metadata_adjusted(score: Column, rule: str, *, watermark: Column, ai_device: Column, camera: Column, verified: Column, image: Column | None = None, suspicious: Column | None = None) -> Column:
    """The score moved by a found watermark's confidence (null for none), the device and verified provenance, clipped to .01 and .99.

    ``rule`` is 'engine' or 'result'.  In 'result' a device moves the score up only for images, by up to three suspicious signs, and a camera counts
    only where it does not.  Null signs are false, a null score stays null.
    """
    sign = lambda c: F.coalesce(c, F.lit(False))
    move = lambda c, by: F.when(c, by).otherwise(0.0)
    sure = sign(watermark > 0.7)
    # Fixed values
    if rule == "engine":
        change = move(sure, 0.10 * watermark) + move(sign(ai_device), 0.06) - move(sign(camera), 0.04) - move(sign(verified), 0.15)
    elif rule == "result":
        signs = F.least(F.coalesce(suspicious, F.lit(0)), F.lit(3)) if suspicious is not None else F.lit(0)
        device = sign(ai_device) & sign(image) if image is not None else F.lit(False)
        change = move(sure, 0.15 * watermark) + F.when(device, 0.08 * signs / 3).otherwise(-move(sign(camera), 0.05)) - move(sign(verified), 0.20)
    else:
        raise ValueError(f"no rule {rule}: engine or result")
    return F.when(score.isNotNull(), clip(score + change))
