"""Operators of a training-data pipeline: tokens, near copies, filters, models.

Functions of this package run inside Python workers too. They travel to the
executors by value, so that a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
