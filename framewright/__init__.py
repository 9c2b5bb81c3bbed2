"""Framewright: event building, frame completion and scheduling as Spark plans."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry the code of this package, which need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
