"""Security-event-log analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are shipped whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
