"""Spatial label analytics on Spark.

Functions that run inside tasks are pickled by value, so that a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
