"""Agent-memory analytics on Spark: retrieval, validation, reconciliation, ingestion and reporting as DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers may start in another folder than the driver: ship this package's functions by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
