"""Registry of named queries: a Spark plan over a table folder, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.plans.adapters import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(Tables) -> DataFrame`` under ``name``; ``sql`` may use the CTEs in ``tables``."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            SQL[name] = (with_tables(*tables) if tables else "") + sql
        return fn

    return register


def day_text(c: str) -> Column:
    """A date as text, so that both engines print it alike."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def time_text(c: str) -> Column:
    """A timestamp as text to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
