"""PySpark-native log analytics engine."""

import sys

from pyspark import cloudpickle

# Python workers may not find this package on their path; its functions then travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
