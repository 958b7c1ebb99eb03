"""All registered queries."""

from postweave.plans import compare, experiment, graph, learn, prep, tags, text  # noqa: F401
from postweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
