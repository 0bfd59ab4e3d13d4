"""Interval, detection, embedding and corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package travel inside the task, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
