"""tickloom: a PySpark-native engine for tables of timed media samples and for text corpora.

Functions that run in Python workers are pickled by value, so the executors
need numpy, pyarrow and the other libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
