"""Mining configuration settings out of document collections, on Spark."""

from pyspark import cloudpickle as _cloudpickle

# The small Python helpers travel inside the jobs that use them, so executors
# need no copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
