"""Compositions and the registered queries."""

from . import alignment_queries, analysis_queries, file_queries, queries  # noqa: F401
