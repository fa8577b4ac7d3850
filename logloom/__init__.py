"""logloom: log structuring, log analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may lack this package: functions go to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
