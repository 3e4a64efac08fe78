"""All registered queries and their SQL counterparts."""

from callbrook.plans import call_queries, kb_queries, qualify_queries, search_queries, stream_queries

_MODULES = (kb_queries, search_queries, call_queries, qualify_queries, stream_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
