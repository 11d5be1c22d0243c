"""amphora: retrieval and knowledge-graph analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value, so executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
