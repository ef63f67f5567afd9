"""Curate and score driving-clip datasets with Spark DataFrames.

Operators take DataFrames and return DataFrames; nothing here holds rows on the
driver.  See README.md for a tour.
"""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors with the plan, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
