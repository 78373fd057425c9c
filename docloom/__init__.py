"""docloom: analytics over versioned document collections, on PySpark.

Functions that run in Python workers are pickled by value, so that executors
need no installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
