"""All registered queries and their SQL."""

from contentlens.plans import corpus, evaluation, evidence, monitoring, operations, series, text  # noqa: F401
from contentlens.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
