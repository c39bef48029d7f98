"""Operators of a training-data pipeline over document tables.

One module per operator; ``queries.py`` registers them.  Nothing else in the
library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
