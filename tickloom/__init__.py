"""tickloom: market-data analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tickloom.session import build_session, durable

# Ship the package's Python functions with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable"]
