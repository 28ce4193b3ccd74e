"""All registered queries: importing the modules registers them."""

from helixframe.plans import annotated, ends, regions, scalar, tables
from helixframe.plans.registry import ORACLES, QUERIES

MODULES = (annotated, ends, regions, scalar, tables)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
