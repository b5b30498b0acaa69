"""A PySpark-native analytics engine for office-style documents and the data inside them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
