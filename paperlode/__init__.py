"""paperlode: document and event evidence analytics, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from paperlode.session import build_session, shared_dir
from paperlode.sources.tables import load_table, load_tables

# Python helpers travel to the workers with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "load_table", "load_tables", "shared_dir"]
