"""Training-data operators. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle as _cloudpickle

import onceflow.llm as _self

# Functions of this subpackage travel to the executors by value, so that they need no copy of it on their path.
_cloudpickle.register_pickle_by_value(_self)
