"""Catalog enrichment and hybrid product search as plain PySpark DataFrame jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the plan, so executors need no
# separate install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
