"""Spark-native assembly-graph and read-path analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value: a cluster needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
