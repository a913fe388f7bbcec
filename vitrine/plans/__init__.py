"""Registered queries (name to function) and their SQL (name to text)."""

from . import aliases, behaviour, catalogue, commerce, evaluation, filters, grounding, language, orders, planning, preparation, presentation, retrieval, running, selection, state, support, vectors
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aliases", "behaviour", "catalogue", "commerce", "evaluation", "filters", "grounding", "language", "orders", "planning", "preparation", "presentation", "retrieval", "running", "selection", "state", "support", "vectors"]
