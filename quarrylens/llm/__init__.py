"""Operators for preparing large text collections. Nothing outside this folder imports it."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Worker functions travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
