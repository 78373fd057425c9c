"""Registered queries: each applies one operator, with its SQL where SQL can
say it."""

from . import content, graph, guides, markup, records, relations, rules, runs, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
