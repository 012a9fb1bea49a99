"""Composable, auditable dataset jobs on PySpark DataFrames.

Functions that run inside tasks are shipped to the executors by value, so a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

from sluice.operators.compose import (
    Branch,
    Chain,
    Derive,
    Merge,
    Summarise,
    Task,
    Where,
    branch,
    chain,
    leaves,
    merge,
    run,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Branch",
    "Chain",
    "Derive",
    "Merge",
    "Summarise",
    "Task",
    "Where",
    "branch",
    "chain",
    "leaves",
    "merge",
    "run",
]
