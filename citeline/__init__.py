"""citeline: research-corpus operators on Spark.

Functions of this package used inside tasks (the TTL fold) are pickled by
value, so executors run them without the package being installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
