"""Imports every module that registers queries."""

from loomgraph.plans import code, events, graphs, retrievals, scalars, stores, streams  # noqa: F401
from loomgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
