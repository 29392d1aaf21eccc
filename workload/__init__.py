"""Queries over the test tables, each with equivalent SQL where SQL can say it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
