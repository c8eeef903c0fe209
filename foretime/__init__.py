"""Point-in-time analytics on Spark: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so no package is shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
