"""Burrows-Wheeler transforms of ordered text collections on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the functions that run in Python workers
# travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
