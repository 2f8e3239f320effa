"""Every registered query of the library and its oracle."""

from tallygrove.plans import extraction_queries, oracles, posting_queries, text_queries, upkeep_queries
from tallygrove.plans.queries import QUERIES

FLAGSHIP = "flagship"


def queries():
    """Name to (spark, sf_dir) -> DataFrame."""
    return QUERIES | posting_queries.QUERIES | extraction_queries.QUERIES | text_queries.QUERIES | upkeep_queries.QUERIES


def oracle_sql():
    """Name to DuckDB SQL."""
    return oracles.SQL | posting_queries.SQL | extraction_queries.SQL | text_queries.SQL | upkeep_queries.SQL
