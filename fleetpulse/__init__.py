"""Asset-health analytics for sensor fleets, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions inside Pandas UDFs travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
