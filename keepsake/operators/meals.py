"""Recipes, meal plans and shopping lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import day
from keepsake.functions.order import pg_asc, pg_desc
from keepsake.functions.predicates import contains_all, has_ingredient_named, ilike_contains
from keepsake.sources.tables import DAYS_OF_WEEK, MEAL_TYPES


def search_recipes(recipes: DataFrame, q: str | None = None, cuisine: str | None = None,
                   tag: str | None = None, ingredient: str | None = None) -> DataFrame:
    """Recipes by name, cuisine, tag and exact ingredient name; newest first."""
    if q:
        recipes = recipes.where(ilike_contains("name", q))
    if cuisine:
        recipes = recipes.where(F.col("cuisine") == cuisine)
    if tag:
        recipes = recipes.where(contains_all("tags", [tag]))
    if ingredient:
        recipes = recipes.where(has_ingredient_named("ingredients", ingredient))
    return recipes.orderBy(pg_desc("created_at"), pg_asc("id"))


def browse_recipes(recipes: DataFrame, q: str | None = None, cuisine: str | None = None,
                   tag: str | None = None) -> DataFrame:
    """The short listing of recipes, by name."""
    if q:
        recipes = recipes.where(ilike_contains("name", q))
    if cuisine:
        recipes = recipes.where(F.col("cuisine") == cuisine)
    if tag:
        recipes = recipes.where(contains_all("tags", [tag]))
    return recipes.select("id", "name", "cuisine", "prep_time_minutes", "cook_time_minutes", "servings",
                          "tags", "rating").orderBy(pg_asc("name"), pg_asc("id"))


def _position(c, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(c))


def meal_plan(plans: DataFrame, recipes: DataFrame, week_start, calendar_order: bool = False,
              with_servings: bool = False) -> DataFrame:
    """Plans of a week with the main recipe fields; custom meals keep NULLs.

    Sorted by day and meal as text, as the original does; ``calendar_order`` sorts Monday first.
    """
    fields = ["name", "cuisine", "prep_time_minutes", "cook_time_minutes"] + (["servings"] if with_servings else [])
    dish = recipes.select(F.col("id").alias("recipe_id"),
                          *[F.col(f).alias(f"recipe_{f}") for f in fields])
    out = plans.where(F.col("week_start") == day(week_start)).join(dish, "recipe_id", "left")
    if calendar_order:
        keys = [_position("day_of_week", DAYS_OF_WEEK).asc(), _position("meal_type", MEAL_TYPES).asc()]
    else:
        keys = [pg_asc("day_of_week"), pg_asc("meal_type")]
    return out.orderBy(*keys, pg_asc("id"))


def plan_rows(requests: DataFrame) -> DataFrame:
    """Meal plan rows of weekly requests ``user_id, week_start, meals`` (an array of ``day_of_week,
    meal_type, recipe_id, custom_meal, servings, notes``), ready for ``append_validated``."""
    return requests.select("user_id", "week_start", F.inline("meals"))


def upcoming_plans(plans: DataFrame, as_of, n: int = 7, column: str = "date") -> DataFrame:
    """The next ``n`` plan rows from today on (rows, although the original calls them days)."""
    return plans.where(F.col(column) >= day(as_of)).orderBy(pg_asc(column), pg_asc("id")).limit(n or 7)


def unpurchased(items: DataFrame) -> DataFrame:
    """Open shopping items, newest first."""
    return items.where(~F.col("purchased")).orderBy(pg_desc("created_at"), pg_asc("id"))


def ingredient_rows(recipes: DataFrame) -> DataFrame:
    """Ingredients as rows: ``recipe_id, user_id, pos, name, unit, quantity``."""
    return recipes.select(F.col("id").alias("recipe_id"), "user_id",
                          F.posexplode("ingredients").alias("pos", "i")).select(
        "recipe_id", "user_id", "pos", "i.name", "i.unit", "i.quantity")


def shopping_list(plans: DataFrame, ingredients: DataFrame, week_start=None) -> DataFrame:
    """Shopping items of each user and week: ``user_id, week_start, name, unit, quantity, purchased,
    recipe_id``.

    ``ingredients`` as from ``ingredient_rows``. Quantities of the same name and unit are listed as
    ``q1 + q2`` in the order day, meal, plan, ingredient; servings are ignored and a recipe planned
    twice counts twice. ``recipe_id`` is the first recipe that needs the item. ``week_start`` narrows
    to one week.

    The text is built in two steps, first within a day and meal, then over the week, so that one
    much-used ingredient is spread over many tasks and only short partial texts meet.
    """
    if week_start is not None:
        plans = plans.where(F.col("week_start") == day(week_start))
    order = plans.select(
        "user_id", "week_start", F.col("id").alias("plan_id"), "recipe_id",
        _position("day_of_week", DAYS_OF_WEEK).alias("day_no"),
        _position("meal_type", MEAL_TYPES).alias("meal_no"))
    lines = order.join(ingredients.drop("user_id"), "recipe_id")
    key = ["user_id", "week_start", "name", "unit"]
    joined = F.expr("listagg(quantity, ' + ') within group (order by plan_id, pos)")
    per_meal = lines.groupBy(*key, "day_no", "meal_no").agg(
        joined.alias("part"), F.min_by("recipe_id", F.struct("plan_id", "pos")).alias("recipe_id"))
    whole = F.expr("listagg(part, ' + ') within group (order by day_no, meal_no)")
    return per_meal.groupBy(*key).agg(
        whole.alias("quantity"), F.lit(False).alias("purchased"),
        F.min_by("recipe_id", F.struct("day_no", "meal_no")).alias("recipe_id"))


def missing_ingredients(ingredients: DataFrame, items: DataFrame) -> DataFrame:
    """Ingredients of each recipe with ``in_stock``: does the user own an item of that name?"""
    needs = ingredients.select("user_id", "recipe_id", F.col("name").alias("ingredient"),
                               F.lower("name").alias("_name"))
    stock = items.select("user_id", F.lower("name").alias("_name")).distinct().withColumn("_have", F.lit(True))
    return (needs.join(stock, ["user_id", "_name"], "left")
            .withColumn("in_stock", F.col("_have").isNotNull()).drop("_name", "_have"))
