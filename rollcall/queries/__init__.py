"""The registered queries, and SQL that gives the same results."""

from . import audit, batches, composites, emails, extraction, folds, graphs, identity, people, publication, relational, sources, state, streams, summaries, text, urls  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
