"""Constraint-driven text augmentation and feature-mining analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
