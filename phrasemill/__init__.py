"""Sorting short texts into categories with Spark: DataFrame operators, model
pipelines, result analysis and one streaming job."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
