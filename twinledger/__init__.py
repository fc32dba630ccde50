"""Content-duplication and event-graph analytics on plain PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from twinledger.plans.pipeline import match_seeds, run_all, run_metadata, run_name, run_seeds, run_uri, select_seeds  # noqa: E402
from twinledger.sources.snapshot import ReadOptions, read_snapshot  # noqa: E402

__all__ = ["ReadOptions", "match_seeds", "read_snapshot", "run_all", "run_metadata", "run_name", "run_seeds", "run_uri", "select_seeds"]
