"""Importing this module registers every core query."""

from paperloom.plans import file_queries, ingest_queries, keyed_queries, reference_queries, report_queries, search_queries, stream_queries, text_queries  # noqa: F401
from paperloom.plans.registry import core  # noqa: F401
