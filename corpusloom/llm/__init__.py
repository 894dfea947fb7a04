"""Training-data operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
