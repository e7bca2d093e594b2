"""Operators that prepare training text: filters, near-duplicate removal, mixing, formatting.

Functions of this package that run in tasks travel with the job, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
