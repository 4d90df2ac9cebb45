"""All queries of the library."""

from palaver.plans import attribution, checks, evaluation, signal, streams, transcript, vectors  # noqa: F401
from palaver.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
