"""All registered queries of the library and their SQL."""

from packgraph.plans import evidence, models  # noqa: F401  add their queries to the registry
from packgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
