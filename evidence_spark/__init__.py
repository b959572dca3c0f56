"""Security-evidence analytics as DataFrame, SQL and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

from evidence_spark.session import build_session, scratch_path, scratch_table

# Functions of this package travel to the Python workers by value, so executors need
# neither an installed copy nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_table", "scratch_path"]
