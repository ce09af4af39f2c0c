"""loam: corpus lineage, clustering and training-data operators on Spark.

Functions of this package run in Python workers as well as on the driver. They
are pickled by value, so an executor needs no copy of the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
