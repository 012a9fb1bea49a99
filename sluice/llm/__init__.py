"""Operators for preparing training text: one module per operator.

Nothing outside this package imports it. Its functions are shipped to executors by value, so
a cluster needs no installed copy.
"""

from pyspark import cloudpickle

import sluice.llm as _package

cloudpickle.register_pickle_by_value(_package)
