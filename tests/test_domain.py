"""Household, maintenance, calendar, meals, contacts, jobs, reviews and transcripts on small fixtures."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keepsake.operators import (calendar, contacts, household, jobs, lookups, maintenance, meals, review,
                                transcripts)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


# ── shared lookups ───────────────────────────────────────────────────────────────────────────────


def test_lookup_reports_missing_and_double(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id int")
    rows = {(r.id, r.v): r.matches for r in lookups.lookup(df, keys, ["id"]).collect()}
    assert rows == {(1, "a"): 1, (2, "b"): 2, (2, "c"): 2, (3, None): 0}


def test_recent_is_half_open_and_newest_first(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 8)), (2, datetime(2024, 1, 15)), (3, datetime(2024, 1, 7, 23)),
                                (4, datetime(2024, 1, 14, 23))], "id int, created_at timestamp")
    assert ids(lookups.recent(df, "2024-01-15", 7)) == [4, 1]


# ── household and maintenance ────────────────────────────────────────────────────────────────────


def test_expiring_ignores_bad_details(spark):
    df = spark.createDataFrame([(1, '{"warranty_until":"2024-02-01"}'), (2, '{"warranty_until":"soon"}'), (3, "{}"), (4, None),
                                (5, "broken"), (6, '{"warranty_until":"2024-03-02"}')], "id int, details string")
    assert ids(household.expiring(df, "2024-02-01", 29)) == [1]


def test_vendor_match_and_last_recommendation(spark):
    vendors = spark.createDataFrame([(1, "u", "Ace Plumbing", "plumber", "1"), (2, "v", "Ace Plumbing", "plumber", "2")],
                                    "id int, user_id string, name string, service_type string, phone string")
    logs = spark.createDataFrame([("a", "u", "ACE plumbing", datetime(2024, 1, 1), "old"), ("b", "u", "ace plumbing", datetime(2024, 2, 1), "new"),
                                  ("c", "u", "ace plumbing", datetime(2024, 3, 1), ""), ("d", "u", "self", datetime(2024, 3, 1), "x"),
                                  ("e", "u", None, datetime(2024, 3, 1), None)],
                                 "id string, user_id string, performed_by string, completed_at timestamp, next_action string")
    joined = {r.id: r.vendor_id for r in household.logs_with_vendor(logs, vendors).collect()}
    assert joined == {"a": 1, "b": 1, "c": 1, "d": None, "e": None}
    assert [(r.vendor_id, r.next_action) for r in household.last_recommendation(logs, vendors).collect()] == [(1, "new")]


@pytest.mark.parametrize("days, expected", [(30, [3, 1, 2]), (0, [3])])
def test_due_includes_overdue_and_zero_days(spark, days, expected):
    df = spark.createDataFrame([(1, datetime(2024, 1, 20)), (2, datetime(2024, 2, 14)), (3, datetime(2023, 1, 1)), (4, None),
                                (5, datetime(2024, 2, 14, 1))], "id int, next_due timestamp")
    assert ids(maintenance.due_within(df, "next_due", "2024-01-15", days)) == expected


def test_history_filters(spark):
    tasks = spark.createDataFrame([(1, "u", "HVAC filter", "hvac"), (2, "u", "Roof", None)], "id int, user_id string, name string, category string")
    logs = spark.createDataFrame([("a", 1, "u", datetime(2024, 1, 1)), ("b", 2, "u", datetime(2024, 1, 2)), ("c", 9, "u", datetime(2024, 1, 2, 1)),
                                  ("d", 1, "other", datetime(2024, 1, 1))], "id string, task_id int, user_id string, completed_at timestamp")
    assert ids(maintenance.maintenance_history(logs, tasks)) == ["c", "b", "a", "d"]
    assert ids(maintenance.maintenance_history(logs, tasks, name="hvac")) == ["a"]
    assert ids(maintenance.maintenance_history(logs, tasks, category="nothing")) == []
    assert ids(maintenance.maintenance_history(logs, tasks, start="2024-01-02", end="2024-01-02")) == ["b"]


# ── calendar ─────────────────────────────────────────────────────────────────────────────────────

ACTIVITY = ("id int, user_id string, family_member_id string, title string, activity_type string, day_of_week string, "
            "start_time string, start_date date, end_date date")


@pytest.fixture(scope="module")
def activities(spark):
    d = lambda m, x: date(2026, m, x)
    return spark.createDataFrame([
        (1, "u", "m1", "once in week", "sports", None, "10:00", d(3, 18), d(3, 18)),
        (2, "u", None, "next Monday", "social", None, "09:00", d(3, 23), d(3, 23)),
        (3, "u", "m1", "weekly, ended long ago", "sports", "tuesday", "08:00", d(1, 1), d(1, 31)),
        (4, "u", "m2", "open ended", "school", None, None, d(1, 5), None),
        (5, "u", None, "weekly open", "travel", "Friday", "11:00", None, None),
        (6, "u", "m2", "over", "travel", None, "07:00", d(3, 1), d(3, 15)),
        (7, "u", "m2", "range", "travel", None, "06:00", d(3, 14), d(3, 17)),
        (8, "u", "m2", "undated", "travel", None, "06:30", None, None)], ACTIVITY)


def test_week_schedule_keeps_the_original_quirks(activities):
    assert ids(calendar.week_schedule(activities, "2026-03-16")) == [7, 3, 2, 1, 5, 4]
    assert ids(calendar.week_schedule(activities, "2026-03-16", member="m1")) == [3, 1]


def test_week_schedule_strict(activities):
    assert ids(calendar.week_schedule(activities, "2026-03-16", strict=True)) == [7, 1, 5]
    assert ids(calendar.week_schedule(activities, "2026-03-16", member="m1", strict=True)) == [1, 5]


def test_member_embed_and_search(spark, activities):
    members = spark.createDataFrame([("m1", "u", "Ann", "child")], "id string, user_id string, name string, relationship string")
    rows = {r.id: r.member_name for r in calendar.with_member(activities, members).collect()}
    assert rows[1] == "Ann" and rows[2] is None and rows[4] is None and len(rows) == 8
    assert ids(calendar.search_activities(activities, q="WEEK", kind="sports", member="m1")) == [1, 3]


def test_between_days(spark):
    df = spark.createDataFrame([(i, date(2024, 1, d)) for i, d in enumerate([14, 15, 22, 23])], "id int, d date")
    assert ids(calendar.between_days(df, "d", "2024-01-15", 7)) == [1, 2]
    assert ids(calendar.between_days(df, "d", "2024-01-15", 0)) == [1, 2, 3]


def test_expand_recurring(activities):
    rows = [(r.id, str(r.on_date)) for r in calendar.expand_recurring(activities, "2026-03-16", "2026-03-23").orderBy("id", "on_date").collect()]
    assert rows == [(1, "2026-03-18"), (2, "2026-03-23"), (5, "2026-03-20"), (7, "2026-03-16"), (7, "2026-03-17")]


@pytest.mark.parametrize("slot_minutes", [15, 60, 1440])
def test_conflicts_match_brute_force(spark, slot_minutes):
    import random
    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    from datetime import timedelta
    rows = []
    for i in range(120):
        start = base + timedelta(minutes=rng.randrange(0, 2000, 5))
        rows.append((i, rng.choice("ab"), start, start + timedelta(minutes=rng.choice([0, 5, 30, 200, 1500]))))
    rows.append((120, "a", rows[0][2], rows[0][3]))
    df = spark.createDataFrame(rows, "id int, user_id string, starts_at timestamp, ends_at timestamp")
    found = [tuple(sorted((r.id_a, r.id_b))) for r in calendar.conflicts(df, ["user_id"], slot_minutes).collect()]
    expected = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]
                and a[2] < a[3] and b[2] < b[3]}
    assert len(found) == len(set(found)) and set(found) == expected


def test_scaled_plan(spark, activities):
    members = spark.createDataFrame([(m, "u", m, "x") for m in ("m1", "m2", "m3")], "id string, user_id string, name string, relationship string")
    plans = spark.createDataFrame([(1, "u", date(2026, 3, 16), 4), (2, "u", date(2026, 3, 16), None), (3, "u", date(2026, 3, 9), 4)],
                                  "id int, user_id string, week_start date, servings int")
    occurrences = calendar.expand_recurring(activities, "2026-03-16", "2026-03-22")
    rows = {r.id: (r.members, r.at_home, r.scaled_servings) for r in calendar.scaled_plan(plans, members, occurrences, "2026-03-16").collect()}
    assert rows == {1: (3, 2, 3), 2: (3, 2, 2)}


# ── meals ────────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def recipes(spark):
    from keepsake.sources.tables import INGREDIENT
    return spark.createDataFrame([
        ("r1", "u", "Rice bowl", "thai", [("rice", "1", "cup"), ("egg", "2", "pc")], ["quick"], datetime(2024, 1, 1)),
        ("r2", "u", "Fried rice", "thai", [("rice", "2", "cup"), ("rice", "50", "g"), ("a-b", "1", "c")], ["quick", "wok"], datetime(2024, 1, 2)),
        ("r3", "u", "Soup", None, [("a", "3", "b-c")], [], datetime(2024, 1, 3))],
        f"id string, user_id string, name string, cuisine string, ingredients array<{INGREDIENT}>, tags array<string>, created_at timestamp")


@pytest.fixture(scope="module")
def plans(spark):
    week = date(2024, 1, 1)
    return spark.createDataFrame([
        (4, "u", week, "monday", "breakfast", "r1"), (3, "u", week, "friday", "lunch", "r2"), (2, "u", week, "monday", "dinner", "r2"),
        (1, "u", week, "sunday", "dinner", None), (5, "u", week, "tuesday", "dinner", "r3"), (6, "u", date(2024, 1, 8), "monday", "dinner", "r1")],
        "id int, user_id string, week_start date, day_of_week string, meal_type string, recipe_id string")


def test_shopping_list_order_and_pairs(recipes, plans):
    rows = meals.shopping_list(plans, meals.ingredient_rows(recipes), "2024-01-01").collect()
    found = {(r.name, r.unit): (r.quantity, r.recipe_id, r.purchased) for r in rows}
    assert found == {("rice", "cup"): ("1 + 2 + 2", "r1", False), ("egg", "pc"): ("2", "r1", False), ("rice", "g"): ("50 + 50", "r2", False),
                     ("a-b", "c"): ("1 + 1", "r2", False), ("a", "b-c"): ("3", "r3", False)}


def test_meal_plan_orders(recipes, plans):
    full = recipes.withColumn("prep_time_minutes", F.lit(1)).withColumn("cook_time_minutes", F.lit(2)).withColumn("servings", F.lit(3))
    assert ids(meals.meal_plan(plans, full, "2024-01-01")) == [3, 4, 2, 1, 5]
    ordered = meals.meal_plan(plans, full, "2024-01-01", calendar_order=True, with_servings=True)
    assert ids(ordered) == [4, 2, 5, 3, 1]
    assert [r.recipe_servings for r in ordered.collect()] == [3, 3, 3, 3, None]


def test_recipe_search(recipes):
    assert ids(meals.search_recipes(recipes, q="RICE")) == ["r2", "r1"]
    assert ids(meals.search_recipes(recipes, tag="wok", cuisine="thai", ingredient="rice")) == ["r2"]
    assert ids(meals.search_recipes(recipes, ingredient="Rice")) == []


def test_missing_ingredients_and_lists(spark, recipes):
    items = spark.createDataFrame([("u", "RICE"), ("other", "egg")], "user_id string, name string")
    rows = {(r.recipe_id, r.ingredient): r.in_stock for r in meals.missing_ingredients(meals.ingredient_rows(recipes), items).collect()}
    assert rows == {("r1", "rice"): True, ("r1", "egg"): False, ("r2", "rice"): True, ("r2", "a-b"): False, ("r3", "a"): False}
    days = spark.createDataFrame([(i, date(2024, 1, d)) for i, d in enumerate([1, 5, 6, 7])], "id int, date date")
    assert ids(meals.upcoming_plans(days, "2024-01-05", 2)) == [1, 2]
    lines = spark.createDataFrame([(1, False, 1), (2, True, 2), (3, False, 3)], "id int, purchased boolean, created_at int")
    assert ids(meals.unpurchased(lines)) == [3, 1]


# ── contacts ─────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (1, "u", "Ann", "Acme", None, "met at conference", ["ai", "vc"], None, date(2024, 1, 14)),
        (2, "u", "bob", None, "CTO acme", "school", ["ai"], "notes", date(2024, 1, 15)),
        (3, "u", "Cy", None, None, None, None, None, None),
        (4, "u", "Di", None, None, None, [], "x", date(2024, 1, 22)), (5, "u", "Ed", None, None, None, [], "x", date(2024, 1, 23))],
        "id int, user_id string, name string, company string, title string, how_we_met string, tags array<string>, notes string, follow_up_date date")


def test_contact_search(people):
    assert ids(contacts.search_contacts(people, "ACME")) == [1, 2]
    assert ids(contacts.search_contacts(people, tags=["ai"], how_met="conference")) == [1]


def test_follow_ups(people):
    rows = [(r.id, r.bucket) for r in contacts.follow_ups(people, "2024-01-15", 0).collect()]
    assert rows == [(1, "overdue"), (2, "upcoming"), (4, "upcoming")]
    assert contacts.follow_up_counts(people, "2024-01-15", 8).first().asDict() == {"user_id": "u", "overdue_count": 1, "upcoming_count": 3}


def test_contact_history_lists_every_contact(spark, people):
    calls = spark.createDataFrame([(10, 1, "u", "call", datetime(2024, 1, 1), "first"), (11, 1, "u", "email", datetime(2024, 1, 3), "second"),
                                   (12, 1, "other", "email", datetime(2024, 1, 4), "not mine")],
                                  "id int, contact_id int, user_id string, interaction_type string, occurred_at timestamp, summary string")
    deals = spark.createDataFrame([(20, 1, "u", "won", datetime(2024, 1, 2), "deal"), (21, 2, "u", "lost", datetime(2024, 1, 2), "deal")],
                                  "id int, contact_id int, user_id string, stage string, created_at timestamp, title string")
    rows = [(r.id, r.interaction_count, r.kind, r.entry_id) for r in contacts.contact_history(people, calls, deals).collect()]
    assert rows[:4] == [(1, 2, "interaction", 11), (1, 2, "interaction", 10), (1, 2, "opportunity", 20), (2, 0, "opportunity", 21)]
    assert rows[4:] == [(3, 0, None, None), (4, 0, None, None), (5, 0, None, None)]


def test_bridge_skips_linked_and_is_stable(spark):
    rows = spark.createDataFrame([("j1", "u", "c1", "Ann", None, None, None, None, "recruiter", None, "n", None),
                                  ("j2", "u", None, "Bo", None, None, None, None, None, "", None, None),
                                  ("j3", "u", "c9", "Cy", None, None, None, None, None, "linked", None, None)],
                                 "id string, user_id string, company_id string, name string, title string, email string, phone string, "
                                 "linkedin_url string, role_in_process string, professional_crm_contact_id string, notes string, last_contacted timestamp")
    firms = spark.createDataFrame([("c1", "Acme")], "id string, name string")
    new, links = contacts.bridge_contacts(rows, firms, "2024-01-01")
    found = {r.name: (r.company, r.how_we_met, r.tags) for r in new.collect()}
    assert found == {"Ann": ("Acme", "Job search - recruiter", ["job-hunt", "recruiter"]), "Bo": (None, "Job search - contact", ["job-hunt", "contact"])}
    assert {r.id for r in new.collect()} == {r.professional_crm_contact_id for r in links.collect()}


def test_linked_thoughts_are_appended_in_order(spark, people):
    thoughts = spark.createDataFrame([("t2", "two"), ("t1", "one")], "id string, content string")
    links = spark.createDataFrame([("t2", 1), ("t1", 1), ("t1", 2), ("gone", 3)], "thought_id string, contact_id int")
    notes = {r.id: r.notes for r in contacts.append_linked_thoughts(people, thoughts, links, "2024-03-01").collect()}
    mark = "\n\n[Linked Thought 2024-03-01]: "
    assert notes == {1: f"{mark}one{mark}two", 2: f"notes{mark}one", 3: None, 4: "x", 5: "x"}


def test_thoughts_about_and_staleness(spark, people):
    thoughts = spark.createDataFrame([(i, datetime(2024, 1, i), ["ANN", "ann"] if i < 5 else ["Zoe"]) for i in range(1, 7)],
                                     "id int, created_at timestamp, people array<string>")
    rows = [(r.contact_id, r.thought_id, r["rank"]) for r in contacts.thoughts_about(people, thoughts, 2).orderBy("rank").collect()]
    assert rows == [(1, 4, 1), (1, 3, 2)]
    calls = spark.createDataFrame([(1, "u", datetime(2024, 1, 1)), (2, "u", datetime(2024, 1, 9))], "contact_id int, user_id string, occurred_at timestamp")
    days = {r.id: r.days_since for r in contacts.staleness(people, calls, "2024-01-10", 8).collect()}
    assert days == {1: 9, 3: None, 4: None, 5: None}


def test_names_in_texts(spark):
    who = spark.createDataFrame([(1, "u", "Ann"), (2, "u", "Ann  de Vries"), (3, "v", "ann"), (4, "u", "?!"), (5, "u", None), (6, "u", "Zoë-K")],
                                "id int, user_id string, name string")
    thoughts = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), "Met ANN, twice: ann", ["x"]), (2, datetime(2024, 1, 2), "Planning with Anna", []),
         (3, datetime(2024, 1, 3), "ann de\nvries called", None), (4, datetime(2024, 1, 4), None, ["Ann"]), (5, datetime(2024, 1, 5), "", []),
         (6, datetime(2024, 1, 6), "zoË k?", []), (7, datetime(2024, 1, 7), "de Vries " + "word " * 3000 + "Ann", ["ann"])],
        "id int, created_at timestamp, content string, people array<string>")
    found = contacts.thoughts_about(who, thoughts, 9, in_text=True).collect()
    assert sorted((r.contact_id, r.thought_id, r["rank"]) for r in found) == [
        (1, t, 5 - i) for i, t in enumerate((1, 3, 4, 7), 1)] + [(2, 3, 1)] + [(3, t, 5 - i) for i, t in enumerate((1, 3, 4, 7), 1)] + [(6, 6, 1)]
    assert contacts.thoughts_about(who.where("id = 4"), thoughts, 9, in_text=True).count() == 0
    assert contacts.thoughts_about(who, thoughts.limit(0), 9, in_text=True).count() == 0


def test_opportunity_totals(spark):
    df = spark.createDataFrame([("u", "won", Decimal("1.10")), ("u", "won", Decimal("2.20")), ("v", "lost", None)], "user_id string, stage string, value decimal(12,2)")
    rows = {(r.user_id, r.stage, r.level): (r.opportunities, r.value) for r in contacts.opportunities_by_stage(df).collect()}
    assert rows[("u", "won", 0)] == (2, Decimal("3.30")) and rows[(None, None, 3)] == (3, Decimal("3.30")) and rows[("v", None, 1)] == (1, None)


# ── job search ───────────────────────────────────────────────────────────────────────────────────


def test_interview_chain_and_overview(spark):
    firms = spark.createDataFrame([(1, "Acme")], "id int, name string")
    posts = spark.createDataFrame([(1, 1, "Dev"), (2, 9, "Orphan")], "id int, company_id int, title string")
    apps = spark.createDataFrame([(1, "u", 1, "applied"), (2, "u", 2, "offer"), (3, "v", 1, "applied")], "id int, user_id string, job_posting_id int, status string")
    talks = spark.createDataFrame([
        (1, "u", 1, "scheduled", datetime(2024, 1, 20)), (2, "u", 1, "completed", datetime(2024, 1, 20)), (3, "u", 2, "scheduled", datetime(2024, 1, 20)),
        (4, "u", 1, "scheduled", datetime(2024, 1, 29)), (5, "u", 1, "scheduled", datetime(2024, 1, 29, 0, 1)), (6, "u", 1, "scheduled", None),
        (7, "u", 9, "scheduled", datetime(2024, 1, 20))], "id int, user_id string, application_id int, status string, scheduled_at timestamp")
    assert ids(jobs.upcoming_interviews(talks, apps, posts, firms, "2024-01-15")) == [1, 4]
    rows = {r.user_id: (r.total_applications, r.applied, r.offer, r.upcoming_interviews) for r in jobs.application_overview(apps, talks, posts, firms, "2024-01-15").collect()}
    assert rows == {"u": (2, 1, 1, 1), "v": (1, 1, 0, 0)}


def test_funnel_and_performance(spark):
    df = spark.createDataFrame([(1, "phone_screen", "completed", 4), (1, "technical", "completed", 2), (2, "phone_screen", "completed", None),
                                (3, "technical", "scheduled", 5)], "application_id int, interview_type string, status string, rating int")
    rows = [(r.stage, r.reached, r.converted, r.rate) for r in jobs.funnel(df, ["phone_screen", "technical", "final"]).orderBy("stage_no").collect()]
    assert rows == [("phone_screen", 2, 1, 0.5), ("technical", 2, 0, 0.0), ("final", 0, None, None)]
    perf = {r.interview_type: (r.interviews, r.avg_rating) for r in jobs.interview_performance(df).collect()}
    assert perf == {"phone_screen": (2, 4.0), "technical": (1, 2.0)}


def test_compensation_rank_with_ties_and_gaps(spark):
    df = spark.createDataFrame([(1, "USD", 100, 300), (2, "USD", 200, None), (3, "USD", None, 900_000), (4, "USD", None, None), (5, "EUR", 1, 1),
                                (6, "USD", 150, 150)], "id int, salary_currency string, salary_min int, salary_max int")
    rows = {r.id: (r.midpoint, r.rank_in_currency) for r in jobs.compensation(df, bucket=10).collect()}
    assert rows == {1: (200.0, 2), 2: (200.0, 2), 3: (900_000.0, 1), 4: (None, None), 5: (1.0, 1), 6: (150.0, 4)}


def test_response_times(spark):
    df = spark.createDataFrame([("u", date(2024, 1, 1), date(2024, 1, d)) for d in (2, 3, 12)] + [("u", date(2024, 1, 1), None)],
                               "user_id string, applied_date date, response_date date")
    row = jobs.response_times(df).first()
    assert (row.answers, row.avg_days, row.median_days) == (3, pytest.approx(14 / 3), 2.0)


# ── reviews and transcripts ──────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def notes(spark):
    row = lambda i, day, kind, topics, people=(), actions=(): (i, datetime(2024, 1, day, 12), kind, "slack", list(topics), list(people), list(actions))
    return spark.createDataFrame([
        row(1, 2, "task", ["a", "a"], ["Ann"]), row(2, 9, "idea", ["b"], ["Ann"], ["call"]), row(3, 10, "task", ["b", "c"], ["Bo"]),
        row(4, 16, "task", ["b"]), row(5, 17, "idea", ["d"], ["Bo"], ["write"]), row(6, 18, "observation", ["b"], ["Cy"])],
        "id int, created_at timestamp, type string, source string, topics array<string>, people array<string>, action_items array<string>")


def test_stats(notes):
    rows = {(r.facet, r.value): r.thoughts for r in review.thought_stats(notes).collect()}
    assert rows[("total", "all")] == 6 and rows[("topic", "a")] == 1 and rows[("topic", "b")] == 4 and rows[("type", "task")] == 3
    top = {(r.facet, r.value) for r in review.thought_stats(notes, 1).collect()}
    assert ("person", "Ann") in top and ("topic", "b") in top and len(top) == 5


def test_weekly_review(notes):
    rows = {r.topic: (r.this_week, r.last_week, r.trend) for r in review.weekly_review(notes, "2024-01-22").collect()}
    assert rows == {"b": (2, 2, "steady"), "c": (0, 1, "dropped"), "d": (1, 0, "new")}
    assert {r.topic: r.earlier for r in review.topic_gaps(notes, "2024-01-22").collect()} == {"a": 1, "c": 1}
    assert [(r.person, r.mentions) for r in review.people_review(notes, "2024-01-22", 5).collect()] == [("Bo", 1), ("Cy", 1)]


def test_open_loops(spark, notes):
    done = spark.createDataFrame([(4,)], "thought_id int")
    assert ids(review.open_loops(notes, done, "2024-01-22")) == [5]


def test_digest_and_trend(notes):
    rows = [(r.section, r["rank"], r.label, r.value) for r in review.daily_digest(notes, "2024-01-10 13:00:00").orderBy("section", "rank").collect()]
    assert rows == [("count", 1, "thoughts", 1.0), ("topic", 1, "b", 1.0), ("topic", 2, "c", 1.0)]
    trend = {(r.topic, str(r.week)): (r.captures, r.previous) for r in review.weekly_trend(notes).collect()}
    assert trend[("b", "2024-01-15")] == (2, 2) and trend[("b", "2024-01-08")] == (2, None)


@pytest.mark.parametrize("lines, first", [(100, 1), (101, 71), (110, 78), (3, 1)])
def test_transcript_tail(spark, lines, first):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, lines + 1)))], "id int, content string")
    rows = [(r.line_no, r.line) for r in transcripts.transcript_tail(docs).collect()]
    assert rows == [(i, f"l{i}") for i in range(first, lines + 1)]


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "first\nThe Budget is set\nlast"), (2, "nothing")], "id int, content string")
    assert [(r.id, r.line_no, r.line) for r in transcripts.find_quotes(docs, "budget").collect()] == [(1, 2, "The Budget is set")]
