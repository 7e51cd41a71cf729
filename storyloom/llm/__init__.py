"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

#: Functions of this subpackage travel to executors by value, so that these need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
