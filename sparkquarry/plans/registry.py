"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from sparkquarry.plans import analytics, history, packages, quality, repo, structure

QUERIES = quality.Q | analytics.Q | repo.Q | packages.Q | structure.Q | history.Q
SQL = quality.SQL | analytics.SQL | repo.SQL | packages.SQL | structure.SQL | history.SQL
FLAGSHIP = "dup_exact_clusters"
