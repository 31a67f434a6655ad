"""Time-series, graph and record analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"
# Grows with each change to what an operator returns.
__build__ = 2

# Functions that run in Python workers are sent with their code, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
