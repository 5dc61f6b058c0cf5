"""Operations of a training-data pipeline over a ``documents`` table.

Nothing else in the library imports this subpackage. Functions that run
inside Python tasks are pickled by value, so the executors need numpy and
the task libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
