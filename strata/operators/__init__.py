"""DataFrame → DataFrame operators, grouped by kind."""

from strata.operators import aggregates, contracts, joins, measures, ordering, quality, windows

__all__ = ["aggregates", "contracts", "joins", "measures", "ordering", "quality", "windows"]
