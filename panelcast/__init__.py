"""Spark-native cleaning, forecasting, backtesting and transfer planning for capacity-bounded weekly panels."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
