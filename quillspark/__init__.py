"""A Spark-first analytics engine for learning data."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions with the task, so nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
