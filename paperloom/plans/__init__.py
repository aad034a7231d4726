"""The registered queries of the document-corpus operators and their SQL."""

from . import changes, enrich, gate, history, indexes, ingest, jobs, pages, rules, streams, sync, upkeep

_PARTS = (pages, indexes, rules, ingest, enrich, jobs, gate, history, changes, upkeep, streams, sync)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
