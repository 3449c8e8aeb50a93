"""Analytics over dependency graphs of source code, and over any nodes and edges, on Spark."""

import sys

from pyspark import cloudpickle

# What runs on executors travels with the job, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "0.2.0"
