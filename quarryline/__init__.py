"""Quarryline: a Spark-first engine for issue triage, code location and corpus preparation."""

import sys

from pyspark import cloudpickle

# Python workers of a cluster need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
