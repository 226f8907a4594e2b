"""Registered queries with their oracle SQL."""

import sys

from pyspark import cloudpickle

# Stub models defined here run inside Python workers; see the note in the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from registry import enrich, search  # noqa: E402,F401
from registry.base import ORACLES, RUNS  # noqa: E402,F401
