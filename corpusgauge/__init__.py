"""Corpus evaluation as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

from corpusgauge.schema import DOC_KEYS, METRICS
from corpusgauge.session import checkpoint_root, get_session

# Python functions of this package travel with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DOC_KEYS", "METRICS", "checkpoint_root", "get_session"]
