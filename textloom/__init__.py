"""textloom: text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so that the package need only be installed on the driver
cloudpickle.register_pickle_by_value(sys.modules[__name__])
