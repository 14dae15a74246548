"""Query plans over the shared tables, registered by name with their SQL oracles.

Importing this package imports every plan module, filling ``REGISTRY``.
"""

from strata.plans.catalog import REGISTRY, Entry, query, table  # noqa: F401
from strata.plans import (aggs_q, columns, joins_q, live_q, measures_q, ml_q, sales, scored_q, stored_q,  # noqa: F401  (register queries)
                          stream_q, windows_q)


def queries():
    return {n: e.fn for n, e in REGISTRY.items()}


def oracle_sql():
    return {n: e.sql for n, e in REGISTRY.items() if e.sql is not None}
