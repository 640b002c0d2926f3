"""raysheaf: Spark-native analytics over particle and cell tables.

Everything is a function from DataFrames or Columns to DataFrames or Columns;
Catalyst plans, Tungsten executes.
"""

import sys

from pyspark import cloudpickle

# Functions of the package travel to executors by value, so that a cluster needs no copy of it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
