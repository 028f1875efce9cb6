"""Operators for building training corpora: extraction, cleaning, deduplication, scoring, tokenising."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
