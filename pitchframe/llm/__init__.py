"""Operators for preparing language-model training text, and their registered queries.

Nothing else in the library imports this subpackage. Its functions travel to the executors by
value, so the library need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
