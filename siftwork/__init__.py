"""siftwork: findings analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel by value, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
