"""Corpus operators for preparing language-model training data.

Functions that run in executors travel by value, so a cluster's workers need
the listed libraries (pyarrow, numpy, ...) but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
