"""Maintenance tasks and their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import moment, plus_days
from keepsake.functions.order import pg_asc, pg_desc
from keepsake.functions.predicates import ilike_contains


def due_within(df: DataFrame, column: str, as_of, days: int = 30) -> DataFrame:
    """Rows due by ``as_of + days``, overdue ones included, soonest first; 0 days means until now."""
    return (df.where(F.col(column).isNotNull() & (F.col(column) <= plus_days(moment(as_of), days)))
            .orderBy(pg_asc(column), pg_asc("id")))


def maintenance_history(logs: DataFrame, tasks: DataFrame, name: str | None = None,
                        category: str | None = None, start=None, end=None) -> DataFrame:
    """Logs with their task, newest first, narrowed by task name, category and time.

    A bare day as ``end`` means its midnight. With a task filter the filtered tasks decide by an
    inner join; without one every log stays and the task is attached where known.
    """
    parents = tasks
    if name:
        parents = parents.where(ilike_contains("name", name))
    if category:
        parents = parents.where(ilike_contains("category", category))
    if start is not None:
        logs = logs.where(F.col("completed_at") >= moment(start))
    if end is not None:
        logs = logs.where(F.col("completed_at") <= moment(end))
    parents = parents.select(F.col("id").alias("task_id"), "user_id",
                             F.col("name").alias("task_name"), F.col("category").alias("task_category"))
    how = "inner" if name or category else "left"
    return logs.join(parents, ["task_id", "user_id"], how).orderBy(pg_desc("completed_at"), pg_asc("id"))


def spend(logs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Cost, visits and last service day by user, category and year.

    Logs are summed per task and year first, so the join carries one row per task and year.
    """
    per_task = logs.groupBy("user_id", "task_id", F.year("completed_at").alias("year")).agg(
        F.sum("cost").alias("cost"), F.count("*").alias("visits"),
        F.max("completed_at").alias("last_service"))
    kinds = tasks.select(F.col("id").alias("task_id"), "user_id", "category")
    return (per_task.join(kinds, ["task_id", "user_id"])
            .groupBy("user_id", "category", "year")
            .agg(F.sum("cost").alias("cost"), F.sum("visits").alias("visits"),
                 F.max("last_service").alias("last_service")))
