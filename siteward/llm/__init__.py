"""Operators for large text corpora (chat formatting, filters, near-copies, packing, sharding).

Functions of this subpackage run inside executors' Python workers.  They are pickled by
value so that a cluster needs no copy of the package on its executors' PYTHONPATH.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
