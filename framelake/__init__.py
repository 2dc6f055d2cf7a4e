"""Dense image sequences as DataFrames of frames: operators, kernels and pipelines on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
