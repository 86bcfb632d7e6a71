"""postmill: bulk analytics for collections of posts and other short documents, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so the executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
