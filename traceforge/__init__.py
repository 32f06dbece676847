"""Spark-native analytics for single-molecule traces and other large tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
