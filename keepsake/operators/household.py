"""Household items and vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import day, days_from
from keepsake.functions.order import pg_asc, pg_desc
from keepsake.functions.predicates import ilike_any, ilike_contains


def search_items(items: DataFrame, q: str | None = None, category: str | None = None,
                 location: str | None = None) -> DataFrame:
    """Items whose name, category, location or notes contain ``q``; newest first."""
    if q:
        items = items.where(ilike_any(["name", "category", "location", "notes"], q))
    if category:
        items = items.where(ilike_contains("category", category))
    if location:
        items = items.where(ilike_contains("location", location))
    return items.orderBy(pg_desc("created_at"), pg_asc("id"))


def list_vendors(vendors: DataFrame, service: str | None = None) -> DataFrame:
    """Vendors by name, optionally of one service type."""
    if service:
        vendors = vendors.where(ilike_contains("service_type", service))
    return vendors.orderBy(pg_asc("name"), pg_asc("id"))


def expiring(items: DataFrame, as_of, days: int = 30, key: str = "warranty_until") -> DataFrame:
    """Items whose free-form details name a date within ``days`` days of ``as_of``.

    A missing key or a text that is no date leaves the item out.
    """
    until = F.try_variant_get(F.try_parse_json("details"), f"$.{key}", "date")
    return (items.withColumn("expires_on", until)
            .where(F.col("expires_on").between(day(as_of), days_from(day(as_of), days)))
            .orderBy(pg_asc("expires_on"), pg_asc("id")))


def logs_with_vendor(logs: DataFrame, vendors: DataFrame) -> DataFrame:
    """Maintenance logs with the vendor their ``performed_by`` names, if any."""
    known = vendors.select(
        F.col("user_id"), F.lower("name").alias("_who"), F.col("id").alias("vendor_id"),
        F.col("name").alias("vendor_name"), "service_type", "phone")
    return (logs.withColumn("_who", F.lower("performed_by"))
            .join(known, ["user_id", "_who"], "left").drop("_who"))


def last_recommendation(logs: DataFrame, vendors: DataFrame) -> DataFrame:
    """What each vendor recommended last: the newest non-empty ``next_action``.

    Logs are reduced to one row per performer before they meet the vendors.
    """
    newest = (logs.where(F.coalesce(F.col("next_action") != "", F.lit(False)))
              .groupBy("user_id", F.lower("performed_by").alias("_who"))
              .agg(F.max(F.struct("completed_at", "id", "next_action")).alias("_last")))
    named = vendors.select("user_id", F.lower("name").alias("_who"), F.col("id").alias("vendor_id"),
                           F.col("name").alias("vendor_name"))
    return named.join(newest, ["user_id", "_who"]).select(
        "user_id", "vendor_id", "vendor_name", F.col("_last.completed_at").alias("completed_at"),
        F.col("_last.next_action").alias("next_action"))
