"""Operators for preparing language-model training data.

Python functions of this package run inside Spark tasks; they are pickled by
value so that executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
