"""PySpark-native batch active learning: pick which rows of a huge table to evaluate next."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with their job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
