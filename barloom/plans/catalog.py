"""Importing the query modules fills the registry."""

from barloom.plans import derivatives, lookups, quality, streams, trading, windows  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
