"""Imports every query module, which fills the registry."""

from geoscore.plans import (  # noqa: F401
    queries_aggregate, queries_columns, queries_composites, queries_joins, queries_rank, queries_sources, queries_spatial,
)
from geoscore.plans.registry import ORACLES, QUERIES  # noqa: F401
