"""Registered queries: every operator over the test tables, with DuckDB SQL to compare against."""

from . import registry
from .registry import ORACLES, QUERIES  # noqa: F401


def load():
    from . import (archive_queries, coverage_queries, ingest_queries, log_queries, mapping_queries,  # noqa: F401
                   metadata_queries, reshape_queries, rule_queries, search_queries, text_queries, tree_queries)
    return registry
