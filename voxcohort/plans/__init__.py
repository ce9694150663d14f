"""Named queries over the driver's tables, by group."""

from . import geometry, masks, measures, tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "geometry", "masks", "measures", "tables"]
