"""Spatial analytics for moving, bounded and point-like entities on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
