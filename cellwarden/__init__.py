"""Mobile-network incident analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so the package does not
# have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
