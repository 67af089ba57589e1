"""Queries over the given tables, and the SQL that checks them."""

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(__import__(__name__))
