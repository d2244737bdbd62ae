"""tagweave: tagged-text preparation, features and classification on Spark.

Every public function takes and returns DataFrames (or Columns); the work
runs as Spark jobs.  See README.md for the operator map.
"""

__version__ = "0.1.0"
