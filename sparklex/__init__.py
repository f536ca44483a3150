"""sparklex: a tokenization engine and corpus toolkit on the Spark DataFrame API.

Functions that run in Python workers are shipped by value, so executors need
numpy and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
