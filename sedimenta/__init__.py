"""Source-code evolution analytics on Spark.

Catalogue of releases -> source files -> code units -> aligned and scored
changes -> per-release statistics, all as DataFrame programs.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing needs to
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
