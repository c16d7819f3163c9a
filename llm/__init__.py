"""Operators for training-data pipelines; importing this package registers nothing by itself.

Functions of this package travel to the executors by value, so a job works where only the driver has the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
