"""Repository-context analytics on Spark: ranking, retrieval, packing, baskets and quality gates over corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
