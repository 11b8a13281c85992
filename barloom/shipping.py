"""Python functions that run on executors travel by value, so that the executors need no installed package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Call at the top of a module whose functions run on executors."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
