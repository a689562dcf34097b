"""newsloom: a PySpark-native engine for acquiring, cleaning and preparing news texts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions for Python workers travel with their jobs, so executors need no installed copy
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
