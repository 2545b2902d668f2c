"""Operators for preparing training text: mixing, cleaning, duplicates, search and archives.

Functions of this package travel to the executors by value, so a job needs nothing installed
there but the Python packages Spark itself uses and numpy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
