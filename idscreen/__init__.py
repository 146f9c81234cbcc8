"""Identity-document screening analytics: functions from DataFrames to a DataFrame."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
