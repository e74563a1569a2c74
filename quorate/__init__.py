"""Retrieval evaluation and selective-decision analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
