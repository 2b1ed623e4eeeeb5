"""soundalike: similarity analytics over feature vectors, written for Spark.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or
a Column).  Single-item request handlers become operators over a table of
queries; a one-row query table is the single request.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
