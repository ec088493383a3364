"""Analysis of large collections of short free-text reports on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with their task, so the package is only needed on the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
