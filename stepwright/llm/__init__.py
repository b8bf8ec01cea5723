"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Python functions that run on executors are pickled by
value, so that executors need the third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
