"""Operators of a training-data pipeline; nothing else in the package imports this one.

Functions that run in tasks are sent to the executors by value: they need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
