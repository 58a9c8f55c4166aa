"""Queries over the given tables, one or more per operator."""

from recordloom.queries import checks, nodes, prose, runs, views
from recordloom.queries.registry import BUILDERS, SQL

__all__ = ["BUILDERS", "SQL", "checks", "nodes", "prose", "runs", "views"]
