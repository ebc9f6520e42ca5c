"""Shipment analytics for Spark: one delivery fact in, business tables out."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so they need not find the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
