"""Family calendar: week schedule, searches, recurring activities and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import day, days_from
from keepsake.functions.order import pg_asc, pg_desc
from keepsake.functions.predicates import ilike_contains


def with_member(df: DataFrame, members: DataFrame) -> DataFrame:
    """Attach the member's name and relationship; rows for the whole family keep NULLs."""
    who = members.select(F.col("id").alias("family_member_id"), "user_id",
                         F.col("name").alias("member_name"), "relationship")
    return df.join(who, ["family_member_id", "user_id"], "left")


def week_schedule(activities: DataFrame, week_start, member: str | None = None,
                  strict: bool = False, members: DataFrame | None = None) -> DataFrame:
    """Activities of a week by start time; with ``members`` each has its member's name and relationship.

    As in the original, the week reaches to the next Monday inclusive, recurring activities ignore
    their date range, and a member filter drops whole-family rows. ``strict`` ends on Sunday, keeps
    recurring activities to their range and keeps whole-family rows.
    """
    first = day(week_start)
    last = F.date_add(first, 6 if strict else 7)
    started = F.col("start_date") <= last
    running = F.col("end_date").isNull() | (F.col("end_date") >= first)
    recurring = F.col("day_of_week").isNotNull()
    if strict:
        begun = F.coalesce(started, recurring)
        shown = begun & running & (recurring | (F.coalesce("end_date", "start_date") >= first))
    else:
        shown = (started & running) | recurring
    out = activities.where(F.coalesce(shown, F.lit(False)))
    if member is not None:
        mine = F.col("family_member_id") == member
        out = out.where(mine | F.col("family_member_id").isNull() if strict else mine)
    if members is not None:  # before the sort: a join keeps no order
        out = with_member(out, members)
    return out.orderBy(pg_asc("start_time"), pg_asc("id"))


def search_activities(activities: DataFrame, q: str | None = None, kind: str | None = None,
                      member: str | None = None) -> DataFrame:
    """Activities by title, type and member; latest start first."""
    if q:
        activities = activities.where(ilike_contains("title", q))
    if kind:
        activities = activities.where(F.col("activity_type") == kind)
    if member:
        activities = activities.where(F.col("family_member_id") == member)
    return activities.orderBy(pg_desc("start_date"), pg_asc("id"))


def between_days(df: DataFrame, column: str, as_of, days: int = 30, members: DataFrame | None = None) -> DataFrame:
    """Rows dated from ``as_of`` to ``days`` days later, both ends included; 0 means 30. With ``members`` each has
    its member's name and relationship."""
    today = day(as_of)
    out = df.where(F.col(column).between(today, days_from(today, days or 30)))
    if members is not None:
        out = with_member(out, members)
    return out.orderBy(pg_asc(column), pg_asc("id"))


def expand_recurring(activities: DataFrame, start, end) -> DataFrame:
    """Dated occurrences (``on_date``) of activities between two days, both included.

    A weekly rule (``day_of_week``) repeats between its start and end dates, either of which may be
    open; an activity without a rule occurs on each day of its range (on its start day when it has no
    end).
    """
    lo, hi = day(start), day(end)
    weekly = F.col("day_of_week").isNotNull()
    first = F.greatest(lo, F.coalesce("start_date", F.when(weekly, lo)))
    last = F.least(hi, F.coalesce("end_date", F.when(weekly, hi).otherwise(F.col("start_date"))))
    ranged = (activities.withColumn("_first", first).withColumn("_last", last)
              .where("_first <= _last and (start_date is not null or day_of_week is not null)"))
    days = F.sequence("_first", "_last", F.expr("interval 1 day"))
    return (ranged.withColumn("on_date", F.explode(days))
            .where(~weekly | (F.lower(F.date_format("on_date", "EEEE")) == F.lower("day_of_week")))
            .drop("_first", "_last"))


def conflicts(slots: DataFrame, who: list[str], slot_minutes: int = 60) -> DataFrame:
    """Pairs of overlapping intervals of the same owner: ``a.start < b.end and b.start < a.end``.

    ``slots``: ``who`` columns, ``id, starts_at, ends_at``. The result has ``id_a, id_b`` in order of
    start, ties by id. Every interval is listed in each time slot it touches and meets only intervals
    that *begin* in that slot, so a pair is found exactly once and a busy owner's rows spread over
    as many keys as there are slots; no owner's intervals are all compared with each other.
    """
    width = slot_minutes * 60
    micros = lambda c: F.unix_micros(c)
    slot = lambda c: F.floor(micros(c) / F.lit(width * 1_000_000)).cast("bigint")
    real = slots.where(F.col("starts_at") < F.col("ends_at"))
    a = real.select(*[F.col(c).alias(f"a_{c}") for c in who],
                    F.col("id").alias("id_a"), F.col("starts_at").alias("a_start"),
                    F.col("ends_at").alias("a_end"),
                    F.explode(F.sequence(slot("starts_at"), slot(F.col("ends_at") - F.expr("interval 1 microsecond"))))
                    .alias("slot_a"))
    b = real.select(*[F.col(c) for c in who], F.col("id").alias("id_b"),
                    F.col("starts_at").alias("b_start"), F.col("ends_at").alias("b_end"),
                    slot("starts_at").alias("slot_b"))
    same = F.col("slot_a") == F.col("slot_b")
    for c in who:
        same = same & (F.col(f"a_{c}") == F.col(c))
    later = (F.col("a_start") < F.col("b_start")) | (
        (F.col("a_start") == F.col("b_start")) & (F.col("id_a") < F.col("id_b")))
    return (b.join(a, same & later & (F.col("b_start") < F.col("a_end")))
            .select(*who, "id_a", "id_b", "a_start", "a_end", "b_start", "b_end"))


def home_counts(members: DataFrame, away: DataFrame) -> DataFrame:
    """Members and members at home per user; ``away`` lists ``user_id, family_member_id``."""
    out = away.select("user_id", F.col("family_member_id").alias("id")).distinct().withColumn("_out", F.lit(1))
    return (members.join(out, ["user_id", "id"], "left").groupBy("user_id")
            .agg(F.count("*").alias("members"), F.count_if(F.col("_out").isNull()).alias("at_home")))


def scaled_plan(plans: DataFrame, members: DataFrame, occurrences: DataFrame, week_start,
                away_type: str = "travel") -> DataFrame:
    """Meal plans of a week with servings scaled to who is home.

    A member with an occurrence of ``away_type`` during the week is away. Servings (the number of
    members where the plan names none) shrink in proportion and round up.
    """
    first = day(week_start)
    away = occurrences.where((F.col("activity_type") == away_type)
                             & F.col("on_date").between(first, F.date_add(first, 6))
                             & F.col("family_member_id").isNotNull())
    home = home_counts(members, away)
    base = F.coalesce(F.col("servings").cast("bigint"), F.col("members"))
    return (plans.where(F.col("week_start") == first).join(home, "user_id", "left")
            .withColumn("scaled_servings", F.ceil(F.try_divide(base * F.col("at_home"), "members"))))
