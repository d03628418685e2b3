"""All queries of the library outside its ``llm`` part, and their SQL."""

from tessera.plans import color_queries, corpus_queries, telemetry_queries, transfer_queries

_MODULES = (color_queries, transfer_queries, telemetry_queries, corpus_queries)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
