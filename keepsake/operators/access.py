"""Row access policies as query scoping: views of a table for one principal.

This decides which rows a query sees. It does not protect the files below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUSEHOLD_ROLE = "household_member"
OPERATIONS = ("select", "insert", "update", "delete")


@dataclass(frozen=True)
class Principal:
    """Who asks: a user id, and the role of the credentials (service credentials bypass policies)."""

    user_id: str | None = None
    role: str = "authenticated"


class AccessDenied(PermissionError):
    """The principal may not do this operation on this table at all."""


Policy = Callable[[DataFrame, Principal], DataFrame]


def own_rows(df: DataFrame, who: Principal) -> DataFrame:
    """Rows of the principal."""
    return df.where(F.col("user_id") == F.lit(who.user_id))


def public_or_own(df: DataFrame, who: Principal) -> DataFrame:
    """Public rows, and the principal's own."""
    return df.where((F.col("visibility") == "public") | (F.col("user_id") == F.lit(who.user_id)))


def role_or_own(df: DataFrame, who: Principal) -> DataFrame:
    """Every row for household credentials, own rows for a user."""
    return df if who.role == HOUSEHOLD_ROLE else own_rows(df, who)


def members_only(members: DataFrame) -> Policy:
    """Rows of the households the principal belongs to (an IN-subquery, planned as a semi-join)."""

    def policy(df: DataFrame, who: Principal) -> DataFrame:
        mine = members.where(F.col("user_id") == F.lit(who.user_id)).select("household_id")
        return df.join(mine, "household_id", "left_semi")

    return policy


def any_of(*tests: Callable[[Principal], "F.Column"]) -> Policy:
    """Several policies on one table: a row is visible when any of them admits it."""

    def policy(df: DataFrame, who: Principal) -> DataFrame:
        condition = F.lit(False)
        for test in tests:
            condition = condition | F.coalesce(test(who), F.lit(False))
        return df.where(condition)

    return policy


def _every(policy: Policy) -> dict[str, Policy]:
    return {op: policy for op in OPERATIONS}


_OWNED = ("household_items", "household_vendors", "maintenance_tasks", "maintenance_logs",
          "family_members", "activities", "important_dates", "professional_contacts",
          "contact_interactions", "opportunities", "companies", "job_postings", "applications",
          "interviews", "job_contacts")

# Tables that are not listed (thoughts among them) are open to service credentials only.
POLICIES: dict[str, dict[str, Policy]] = {
    **{name: _every(own_rows) for name in _OWNED},
    "recipes": {**_every(own_rows), "select": role_or_own},
    "meal_plans": {**_every(own_rows), "select": role_or_own},
    "shopping_lists": {**_every(own_rows), "select": role_or_own, "update": role_or_own},
    "visible_recipes": {**_every(own_rows), "select": public_or_own},
}


def scoped_view(df: DataFrame, table: str | Policy, who: Principal, op: str = "select",
                policies: dict[str, dict[str, Policy]] | None = None) -> DataFrame:
    """The rows of ``df`` that ``who`` may use for ``op``; ``AccessDenied`` when none ever can be.

    ``table`` names a policy set, or is a policy itself. Household credentials carry no user, so
    operations granted to owners only are denied to them.
    """
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}")
    if who.role == "service_role":
        return df
    if callable(table):
        return table(df, who)
    policy = (policies or POLICIES).get(table, {}).get(op)
    if policy is None:
        raise AccessDenied(f"{op} on {table}")
    if who.user_id is None and not (policy is role_or_own and who.role == HOUSEHOLD_ROLE) \
            and policy is not public_or_own:
        raise AccessDenied(f"{op} on {table}")
    return policy(df, who)
