"""All queries of the library with their SQL twins, by name."""

from quire.queries import job_queries, layout_queries, parts_queries, plan_queries, text_queries

MODULES = (text_queries, layout_queries, job_queries, parts_queries, plan_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
