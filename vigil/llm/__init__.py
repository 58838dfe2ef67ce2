"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Functions that run in Python workers
are pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
