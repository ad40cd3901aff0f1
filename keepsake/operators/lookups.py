"""Filters every domain shares: owner, keys, source and age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import moment
from keepsake.functions.order import pg_desc


def for_user(df: DataFrame, user_id) -> DataFrame:
    """Rows of one user."""
    return df.where(F.col("user_id") == F.lit(user_id))


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows by a table of keys, with ``matches`` telling how many rows each key found.

    A key that does not find exactly one row is an error for the caller: keep ``matches != 1``.
    Unknown keys come back with NULL columns and 0 matches.
    """
    asked = keys.select(*on).distinct()
    found = df.join(asked, on, "left_semi")  # the table is never the outer side: a hot key's rows can be split
    counts = found.groupBy(*on).agg(F.count("*").alias("matches"))
    unknown = asked.join(counts, on, "left_anti").withColumn("matches", F.lit(0).cast("long"))
    return found.join(counts, on).unionByName(unknown, allowMissingColumns=True)


def with_count(df: DataFrame, per: list[str]) -> DataFrame:
    """Rows with the size of their result group as ``count`` (pre-aggregated, then joined)."""
    return df.join(df.groupBy(*per).agg(F.count("*").alias("count")), per)


def from_source(df: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    """Keep thoughts of some sources; apply before ranking so that other contexts cost nothing."""
    return df.where(F.col(column).isin(*sources))


def recent(df: DataFrame, as_of, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days, newest first: ``as_of - days <= t < as_of``."""
    end = moment(as_of)
    start = end - F.make_dt_interval(F.lit(days))
    return df.where((F.col(column) >= start) & (F.col(column) < end)).orderBy(pg_desc(column), pg_desc("id"))


def browse(df: DataFrame, kind: str | None = None, topic: str | None = None,
           person: str | None = None) -> DataFrame:
    """Thoughts by type, topic and person."""
    if kind is not None:
        df = df.where(F.col("type") == kind)
    if topic is not None:
        df = df.where(F.array_contains("topics", topic))
    if person is not None:
        df = df.where(F.exists("people", lambda p: F.lower(p) == F.lower(F.lit(person))))
    return df
