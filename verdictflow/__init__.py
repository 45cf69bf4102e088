"""Streaming record scoring on Spark: replay, score, land, inspect."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The scoring stage runs in Python workers. Shipping this small package with the
# task closure saves installing it on every executor.
register_pickle_by_value(sys.modules[__name__])
