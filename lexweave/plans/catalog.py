"""All registered queries of the core and their SQL."""

from __future__ import annotations

from . import clusters, features, loading, pipelines, problems, retrieval

PARTS = (problems, loading, retrieval, features, clusters, pipelines)
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: s for p in PARTS for k, s in p.ORACLES.items()}
