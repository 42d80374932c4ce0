"""millrace: a PySpark-native analytics engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that executors run travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
