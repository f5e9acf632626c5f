"""costgrain: usage and cost accounting on PySpark, with corpus operators beside it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so a cluster needs no
# copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
