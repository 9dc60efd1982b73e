"""Quality, curation and search of text-document corpora on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
