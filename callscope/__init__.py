"""Call-capture analytics as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to executors by value, so that the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
