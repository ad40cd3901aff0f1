"""Batch loads of the domain tables: orders turned into rows with gaps, zeros, unknown values and lost parents.

For each table: what the rows are made of, which rules they must break (in the order of the report), and what the
loaded values must be. Expressions are SQL over ``k`` (order key), ``c`` (customer key) and ``d`` (order date) that both
engines read alike; what is expected is written out here and not taken from the table rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import validation
from keepsake.plans.catalog import query
from keepsake.sources.tables import TABLES

AS_OF = "2024-02-01"
_GAP = "CASE WHEN k % 5 <> 0 THEN 'n' END"  # a required text that is missing now and then
_OWNER = "CAST(c % 25 AS VARCHAR(9))"

# table: (columns of the rows, broken rules with their conditions, expected values)
LOADS = {
    "household_items": (
        {"name": _GAP, "category": "CASE WHEN k % 2 = 0 THEN '' ELSE 'paint' END", "location": "CASE WHEN k % 3 = 0 THEN 'hall' END",
         "notes": "''", "details": "CASE WHEN k % 4 = 0 THEN '{\"coats\":2}' END"},
        [("name required", "k % 5 = 0")],
        {"category": "CASE WHEN k % 2 <> 0 THEN 'paint' END", "location": "CASE WHEN k % 3 = 0 THEN 'hall' END", "notes": "NULL",
         "details": "CASE WHEN k % 4 = 0 THEN '{\"coats\":2}' ELSE '{}' END"}),
    "maintenance_tasks": (
        {"name": _GAP, "priority": "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'high' WHEN 2 THEN 'soon' END", "frequency_days": "CAST(k % 3 AS INT)"},
        [("name required", "k % 5 = 0"), ("priority legal", "k % 4 = 2")],
        {"priority": "CASE k % 4 WHEN 1 THEN 'high' WHEN 2 THEN 'soon' ELSE 'medium' END", "frequency_days": "nullif(CAST(k % 3 AS INT), 0)"}),
    "maintenance_logs": (
        {"task_id": "CASE WHEN k % 7 <> 0 THEN CAST(c AS VARCHAR(9)) END", "cost": "CAST(k % 2 AS DOUBLE)", "notes": "''"},
        [("task_id required", "k % 7 = 0"), ("task_id has no parent in maintenance_tasks", "k % 7 <> 0 AND c % 3 = 0")],
        {"cost": "CASE WHEN k % 2 = 1 THEN '1.00' END", "notes": "NULL", "completed_at": f"'{AS_OF} 00:00:00'"}),
    "family_members": ({"name": _GAP}, [("name required", "k % 5 = 0")], {"notes": "NULL"}),
    "activities": (
        {"title": _GAP, "family_member_id": "CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(c AS VARCHAR(9)) END"},
        [("title required", "k % 5 = 0"), ("family_member_id has no parent in family_members", "k % 3 = 1 AND c % 3 = 0")],
        {"family_member_id": "CASE WHEN k % 3 = 1 THEN 'c' END"}),
    "important_dates": (
        {"title": "'t'", "date_value": "CASE WHEN k % 5 <> 0 THEN CAST(d AS DATE) END", "reminder_days_before": "CAST(k % 3 AS INT)"},
        [("date_value required", "k % 5 = 0")],
        {"reminder_days_before": "CASE k % 3 WHEN 0 THEN 7 ELSE k % 3 END", "recurring_yearly": "'false'"}),
    "recipes": (
        {"name": _GAP, "rating": "CAST(k % 8 AS INT)", "servings": "0"},
        [("name required", "k % 5 = 0"), ("rating in range", "k % 8 NOT BETWEEN 1 AND 5")], {"servings": "0", "rating": "k % 8"}),
    "meal_plans": (
        {"week_start": "CAST(d AS DATE)", "day_of_week": "'monday'", "servings": "CAST(k % 2 AS INT)",
         "meal_type": "CASE k % 4 WHEN 0 THEN 'lunch' WHEN 1 THEN 'brunch' WHEN 2 THEN 'snack' END",
         "recipe_id": "CASE WHEN k % 3 = 0 THEN CAST(c AS VARCHAR(9)) ELSE '' END"},
        [("meal_type required", "k % 4 = 3"), ("meal_type legal", "k % 4 = 1"), ("recipe_id has no parent in recipes", "k % 3 = 0 AND c % 3 = 0")],
        {"servings": "nullif(k % 2, 0)"}),
    "shopping_lists": ({"week_start": "CASE WHEN k % 5 <> 0 THEN CAST(d AS DATE) END"}, [("week_start required", "k % 5 = 0")], {"notes": "NULL"}),
    "professional_contacts": ({"name": _GAP, "company": "CASE WHEN k % 2 = 0 THEN '' ELSE 'x' END"}, [("name required", "k % 5 = 0")],
                              {"company": "CASE WHEN k % 2 <> 0 THEN 'x' END"}),
    "contact_interactions": (
        {"contact_id": "CAST(c AS VARCHAR(9))", "summary": "'s'", "interaction_type": "CASE WHEN k % 4 = 0 THEN 'fax' ELSE 'call' END"},
        [("interaction_type legal", "k % 4 = 0"), ("contact_id has no parent in professional_contacts", "c % 3 = 0")],
        {"occurred_at": f"'{AS_OF} 00:00:00'", "follow_up_needed": "'false'"}),
    "companies": (
        {"name": _GAP, "size": "CASE k % 3 WHEN 0 THEN 'huge' WHEN 1 THEN '' ELSE 'startup' END", "glassdoor_rating": "CAST(k % 7 AS DOUBLE)"},
        [("name required", "k % 5 = 0"), ("size legal", "k % 3 = 0"), ("glassdoor_rating in range", "k % 7 = 6")],
        {"size": "CASE k % 3 WHEN 0 THEN 'huge' WHEN 2 THEN 'startup' END"}),
    "job_postings": (
        {"company_id": "CAST(c AS VARCHAR(9))", "title": _GAP, "salary_currency": "''", "salary_min": "CAST(k % 2 AS INT)",
         "source": "CASE WHEN k % 4 = 0 THEN 'rumour' ELSE '' END"},
        [("title required", "k % 5 = 0"), ("source legal", "k % 4 = 0"), ("company_id has no parent in companies", "c % 3 = 0")],
        {"salary_currency": "'USD'", "salary_min": "nullif(k % 2, 0)"}),
    "applications": (
        {"job_posting_id": "CAST(c AS VARCHAR(9))", "status": "CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'ghosted' ELSE 'offer' END"},
        [("status legal", "k % 3 = 1"), ("job_posting_id has no parent in job_postings", "c % 3 = 0")],
        {"status": "CASE k % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'ghosted' ELSE 'offer' END"}),
    "interviews": (
        {"application_id": "CAST(c AS VARCHAR(9))", "status": "'completed'", "interview_type": "CASE WHEN k % 4 = 0 THEN 'tea' ELSE 'final' END",
         "rating": "CAST(k % 7 AS INT)"},
        [("interview_type legal", "k % 4 = 0"), ("rating in range", "k % 7 NOT BETWEEN 1 AND 5"), ("application_id has no parent in applications", "c % 3 = 0")],
        {"status": "'scheduled'"}),
    "job_contacts": (
        {"name": _GAP, "role_in_process": "CASE k % 3 WHEN 0 THEN 'boss' WHEN 1 THEN 'recruiter' END", "company_id": "CASE WHEN k % 2 = 0 THEN CAST(c AS VARCHAR(9)) END"},
        [("name required", "k % 5 = 0"), ("role_in_process legal", "k % 3 = 0"), ("company_id has no parent in companies", "k % 2 = 0 AND c % 3 = 0")],
        {"role_in_process": "CASE k % 3 WHEN 0 THEN 'boss' WHEN 1 THEN 'recruiter' END"}),
    "shopping_list_items": ({"item": _GAP, "quantity": "CASE WHEN k % 2 = 0 THEN '' ELSE '3' END", "purchased": "true"}, [("item required", "k % 5 = 0")],
                            {"quantity": "CASE WHEN k % 2 = 0 THEN '1' ELSE '3' END", "purchased": "'false'"}),
}


def _register(name: str) -> None:
    columns, broken, expected = LOADS[name]
    report = " || ".join(f"CASE WHEN {test} THEN '{rule}; ' ELSE '' END" for rule, test in broken)
    values = ", ".join(f"CAST({value} AS VARCHAR) AS {column}" for column, value in expected.items())
    sql = f"""
      WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d FROM orders)
      SELECT {report} AS violations, {values}, count(*) AS n FROM o GROUP BY ALL"""

    @query(f"load_{name}", sql)
    def load(t):
        rows = t.read("orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderdate AS d")
        made = rows.selectExpr("CAST(k AS STRING) AS id", *([f"{_OWNER} AS user_id"] if "user_id" in TABLES[name].ddl else []),
                               *(f"{value} AS {column}" for column, value in columns.items()))
        people = t.read("customer").where("c_custkey % 3 <> 0").selectExpr("CAST(c_custkey AS STRING) AS id", "CAST(c_custkey % 25 AS STRING) AS user_id")
        checked = validation.checked(made, name, {k.parent: people for k in TABLES[name].foreign_keys}, AS_OF)
        told = F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit("; "))), "")
        shown = [(F.when(F.col(c).isNotNull(), "c") if c == "family_member_id" else
                  F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c.endswith("_at") else F.col(c).cast("string")).alias(c) for c in expected]
        return checked.select(told.alias("violations"), *shown).groupBy("violations", *expected).agg(F.count(F.lit(1)).alias("n"))

    load.__doc__ = f"Orders loaded as rows of {name}."


for _name in LOADS:
    _register(_name)
