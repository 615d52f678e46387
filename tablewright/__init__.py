"""Spark operators for the table work around language-model tuning and evaluation."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
