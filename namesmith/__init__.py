"""Entity resolution of author mentions, and training-data operators, on Spark.

What runs inside tasks travels to the executors by value, so a cluster needs
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
