"""Named queries over the benchmark tables, each with the SQL it must agree with."""

from keepsake.plans import (domain_queries, import_queries, load_queries, review_queries, search_queries,  # noqa: F401
                            state_queries, stream_queries)
from keepsake.plans.catalog import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)
