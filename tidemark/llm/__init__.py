"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code along, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
