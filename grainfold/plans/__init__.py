"""All registered queries: one per operator, each over whole tables."""

from grainfold.plans.base import ORACLES, QUERIES
from grainfold.plans import (  # noqa: F401
    analyst_queries, chart_queries, cleaning_queries, ml_queries, relational, scalars, stream_queries)

__all__ = ["ORACLES", "QUERIES"]
