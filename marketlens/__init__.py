"""Retail analytics operators expressed as Spark DataFrame plans."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to tasks take the package's code along, so executors need no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
