"""Training-data operators.  Nothing else in the library imports this subpackage.

Functions sent to executors carry this subpackage's code with them, so a cluster needs no copy of it on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
