"""Operators of a training-data pipeline: mixing, language id, quality rules and
classifier, decontamination, token counts, near-duplicates, line dedup, LM
scoring and toxicity.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need not have
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
