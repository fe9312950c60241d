"""Registered queries with the SQL they are checked against."""

from testpulse.catalog import (  # noqa: F401  (each module registers its queries)
    classification,
    comparison,
    extraction,
    runs,
    scoring,
    statistics,
    streams,
    tables,
    reports,
)
from testpulse.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
