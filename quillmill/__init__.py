"""Quillmill: corpus curation as Spark DataFrame operators."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions of this package that run in Python workers travel by value, so that
# executors need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
