"""Registered queries, one per operator, each with its SQL twin where SQL can say it.

"""

from . import (  # noqa: F401  (importing a module registers its queries)
    aggregates, correlations, distributions, evaluations, joins, metadata, profiles, projections, scoring, sources,
    streams, texts,
)
from .base import QUERIES

__all__ = ["QUERIES"]
