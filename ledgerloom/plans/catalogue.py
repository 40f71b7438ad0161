"""Every registered query of the engine proper, with the SQL that states it."""

from __future__ import annotations

from ledgerloom.plans import app, composites, curation, desk, extras, graph, passages, records, resolution, search, stored

PARTS = (search, graph, records, app, passages, resolution, composites, curation, desk, extras, stored)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
