"""quietlog: usage, privacy and transcript analytics for chat traffic, on PySpark."""

import sys

from pyspark import cloudpickle

# ship Arrow functions by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
