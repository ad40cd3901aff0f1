"""Sort orders that place NULLs where the original relational store placed them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_asc(c) -> Column:
    """Ascending with NULLs last (Spark's own default is NULLs first)."""
    return _col(c).asc_nulls_last()


def pg_desc(c) -> Column:
    """Descending with NULLs first."""
    return _col(c).desc_nulls_first()
