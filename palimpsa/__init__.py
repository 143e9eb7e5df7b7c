"""Corpus text hygiene as Spark column expressions, joins, windows and streams."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in workers travel by value, so executors need not hold this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
