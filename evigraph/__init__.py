"""Evidence-graph, document and retrieval analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with their job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
