"""Building text-to-record training tables and scoring predicted records, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
