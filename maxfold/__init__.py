"""maxfold: late-interaction and dense vector retrieval as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions for Python workers travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
