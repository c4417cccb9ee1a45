"""tabeval: prepare, split, fit, score, measure and compare binary classifiers on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
