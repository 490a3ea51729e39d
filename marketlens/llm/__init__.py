"""Operators for building a training corpus; nothing else in the library imports them."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to tasks take this package's code along, so executors need no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
