"""All registered queries."""

from __future__ import annotations

from reelwise.plans import (  # noqa: F401  (importing a module registers its queries)
    candidating,
    evaluating,
    learning,
    preparing,
    profiling,
    recalling,
    sampling,
    storing,
)
from reelwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
