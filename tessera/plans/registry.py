"""Every registered query of the raster library and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import container_queries, filter_queries, raster_queries

MODULES = (filter_queries, raster_queries, container_queries)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
