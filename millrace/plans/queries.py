"""All registered queries: each of these modules registers its own."""

from __future__ import annotations

from millrace.plans import building, catalog, corpora, evaluation, rollouts, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
