"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job: executors need not hold this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
