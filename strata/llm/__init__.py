"""Operators for building training data: quality rules, near-duplicate search,
secret scans, suffix dedup, a quality classifier, PII surrogates, byte-level
BPE, line dedup, chat formatting and benchmark decontamination.

Nothing else in the library imports this package.  Its functions are pickled
by value, so that Python workers need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
