"""All registered queries over the given tables."""

from psephos.plans import archives, events, models, panel, posts, simulation, sources  # noqa: F401  they register themselves
from psephos.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
