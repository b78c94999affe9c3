"""Dataset profiling, drift scoring and report decisions as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that Spark ships to Python workers travel with their code, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
