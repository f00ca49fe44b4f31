"""Operators of a training-data pipeline. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the tasks: executors need no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
