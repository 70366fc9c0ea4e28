"""Timed-text analytics on Spark: captions, frames and pages of many recordings as DataFrames.

Functions that run on executors are pickled by value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
