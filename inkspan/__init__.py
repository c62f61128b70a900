"""inkspan: document-intelligence and indicator-graph analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from inkspan.session import build_session

# functions that run in Python workers travel with their job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
