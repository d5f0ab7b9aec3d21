"""Tidelight: irregular time-series and sky-catalog analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# The kernels are sent to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
