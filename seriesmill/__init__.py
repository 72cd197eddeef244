"""Analytics for many price series at once, written with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task instead of being
# imported there, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
