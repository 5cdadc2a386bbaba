"""marlstone: a PySpark-native engine for panel time series and market research."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the plan, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
