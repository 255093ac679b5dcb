"""tablewright: build and judge tabular machine-learning data with Spark.

Every operator takes and returns DataFrames.  The packages are

* ``sources``    readers and writers,
* ``functions``  column expressions,
* ``plans``      schema facts and collection configuration (no data),
* ``operators``  batch operators,
* ``streaming``  the same operators on unbounded input,
* ``catalog``    the registered queries and their SQL twins.
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
