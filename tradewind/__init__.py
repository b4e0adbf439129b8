"""Retail behaviour analytics, search and recommendation operators for Apache Spark.

Every operator is a function from DataFrames to a DataFrame; nothing in the core
collects row data to the driver.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
