"""corpuskit: a PySpark-native engine for building and inspecting language-model text corpora."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel with their code, so workers need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
