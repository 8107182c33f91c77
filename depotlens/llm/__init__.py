"""Operators of a training-data pipeline. Nothing else of the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
