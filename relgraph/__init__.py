"""relgraph: graph and data-quality operators over ordinary relational tables, planned as Spark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
