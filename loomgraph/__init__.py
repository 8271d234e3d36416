"""Spark-native analytics over source-code corpora and the events around them."""

import sys

from pyspark import cloudpickle

# Python functions used in UDFs travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
