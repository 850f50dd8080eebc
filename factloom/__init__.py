"""factloom: evidence-first analytics on Spark.

Functions that run in Python workers are pickled by value, so executors need
only the third-party libraries and not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
