"""Queries over the star-schema tables, each with its SQL twin where SQL can express it."""

from tidemark.plans import models, relational, studies  # noqa: F401  (they register their queries)
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
