"""State from logs, patches, upserts, referential actions, validation and access."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.operators import access, state, validation
from keepsake.operators.access import HOUSEHOLD_ROLE, AccessDenied, Principal, scoped_view
from keepsake.sources.tables import SHOPPING_ITEM, TABLES


def test_task_state_follows_insertion_not_completion(spark):
    tasks = spark.createDataFrame([(1, 90, None, None), (2, None, None, datetime(2024, 5, 1)), (3, 30, datetime(2023, 1, 1), datetime(2023, 2, 1))],
                                  "id int, frequency_days int, last_completed timestamp, next_due timestamp")
    logs = spark.createDataFrame([("a", 1, datetime(2024, 3, 1), 1), ("b", 1, datetime(2024, 1, 1), 2), ("c", 2, datetime(2024, 2, 1), 3)],
                                 "id string, task_id int, completed_at timestamp, ingest_seq long")
    rows = {r.id: (r.last_completed, r.next_due) for r in state.task_state(tasks, logs).collect()}
    assert rows == {1: (datetime(2024, 1, 1), datetime(2024, 3, 31)), 2: (datetime(2024, 2, 1), None), 3: (datetime(2023, 1, 1), datetime(2023, 2, 1))}
    fallback = {r.id: r.last_completed for r in state.task_state(tasks, logs.drop("ingest_seq")).collect()}
    assert fallback[1] == datetime(2024, 3, 1)


def test_last_contacted_may_move_back(spark):
    people = spark.createDataFrame([(1, None), (2, datetime(2020, 1, 1))], "id int, last_contacted timestamp")
    calls = spark.createDataFrame([(1, 1, datetime(2024, 5, 1), datetime(2024, 5, 1)), (2, 1, datetime(2024, 1, 1), datetime(2024, 6, 1))],
                                  "id int, contact_id int, occurred_at timestamp, created_at timestamp")
    rows = {r.id: r.last_contacted for r in state.last_contacted(people, calls).collect()}
    assert rows == {1: datetime(2024, 1, 1), 2: datetime(2020, 1, 1)}


def test_patch_distinguishes_null_from_absent(spark):
    df = spark.createDataFrame([(1, "u", "a", 5, datetime(2020, 1, 1)), (2, "u", "b", 6, datetime(2020, 1, 1)), (3, "v", "c", 7, datetime(2020, 1, 1))],
                               "id int, user_id string, name string, rating int, updated_at timestamp")
    patch = spark.createDataFrame([(1, "u", "new", None, ["name"], 1), (1, "u", None, None, ["rating"], 2), (1, "u", "newer", None, ["name"], 3),
                                   (3, "u", "not mine", None, ["name"], 1)],
                                  "id int, user_id string, name string, rating int, fields array<string>, seq int")
    rows = {r.id: (r.name, r.rating, r.updated_at) for r in state.apply_patch(df, patch, ["id", "user_id"], "2024-01-01", seq="seq").collect()}
    assert rows == {1: ("newer", None, datetime(2024, 1, 1)), 2: ("b", 6, datetime(2020, 1, 1)), 3: ("c", 7, datetime(2020, 1, 1))}


def test_complete_interviews(spark):
    df = spark.createDataFrame([(1, "u", "scheduled", "old", 1), (2, "u", "cancelled", None, None)], "id int, user_id string, status string, feedback string, rating int")
    notes = spark.createDataFrame([(1, "u", "", 0)], "id int, user_id string, feedback string, rating int")
    rows = {r.id: (r.status, r.feedback, r.rating) for r in state.complete_interviews(df, notes).collect()}
    assert rows == {1: ("completed", None, None), 2: ("cancelled", None, None)}


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([("u", 1, "id1", "x"), ("u", 2, "id2", "y")], "user_id string, week int, id string, items string")
    new = spark.createDataFrame([("u", 2, "other", "Y"), ("u", 3, "id3", "Z")], "user_id string, week int, id string, items string")
    rows = {r.week: (r.id, r["items"]) for r in state.upsert_latest(old, new, ["user_id", "week"], keep=("id",)).collect()}
    assert rows == {1: ("id1", "x"), 2: ("id2", "Y"), 3: ("id3", "Z")}


def test_purchased_is_set_for_every_unit(spark):
    lists = spark.createDataFrame([(1, "u", [("rice", "1", "cup", False, "r"), ("rice", "5", "g", False, "r"), ("egg", "1", "pc", True, "r")]),
                                   (2, "u", [("rice", "1", "cup", False, "r")])], f"id int, user_id string, items array<{SHOPPING_ITEM}>")
    changes = spark.createDataFrame([(1, "u", "rice", True), (1, "u", "egg", False), (1, "u", "unknown", True), (2, "other", "rice", True)],
                                    "id int, user_id string, item_name string, purchased boolean")
    rows = {r.id: [i.purchased for i in r["items"]] for r in state.set_purchased(lists, changes).collect()}
    assert rows == {1: [True, True, False], 2: [False]}


def test_cascade_and_set_null(spark):
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, parent int")
    gone = spark.createDataFrame([(1,), (1,)], "pid int")
    assert {r.id for r in state.cascade(child, gone, ("parent", "pid")).collect()} == {2, 3}
    assert {r.id: r.parent for r in state.cascade(child, gone, ("parent", "pid"), "set_null").collect()} == {1: None, 2: 2, 3: None}
    with pytest.raises(ValueError):
        state.cascade(child, gone, ("parent", "pid"), "explode")


def test_edits_and_inventories(spark):
    df = spark.createDataFrame([("c", "1", 1, "old"), ("c", "1", 2, "new"), ("d", "1", 1, "other")], "channel string, message_id string, edited_at int, text string")
    assert sorted(r.text for r in state.latest_edit(df).collect()) == ["new", "other"]
    assert state.latest_edit(df, update_on_edit=False).count() == 3
    a = spark.createDataFrame([("x", 1)], "title string, line int")
    b = spark.createDataFrame([("x", 9), ("y", 2), ("y", 3)], "title string, line int")
    assert {(r.title, r.line) for r in state.merge_inventories(a, b, ["title"]).collect()} == {("x", 1), ("y", 2)}


def test_touch(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 1))], "id int, updated_at timestamp")
    rows = {r.id: r.updated_at for r in state.touch(df, F.col("id") == 1, "2024-01-01").collect()}
    assert rows == {1: datetime(2024, 1, 1), 2: datetime(2020, 1, 1)}


# ── validation ───────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("name", sorted(TABLES))
def test_every_table_accepts_a_minimal_row_and_rejects_violations(spark, name):
    spec = TABLES[name]
    fields = {f.name: f.dataType for f in T._parse_datatype_string(spec.ddl).fields}
    some = {T.StringType: "'x'", T.DateType: "date'2024-01-01'"}
    minimal = ", ".join(f"{spec.enums[c][0]!r} as {c}" if c in spec.enums else f"{some[type(fields[c])]} as {c}" for c in spec.required)
    unchecked = {k.parent: None for k in spec.foreign_keys}
    good, bad = validation.append_validated(spark.sql(f"select {minimal}"), spec, unchecked, "2024-01-01")
    assert good.count() == 1 and bad.count() == 0 and good.columns == list(fields)
    for column in spec.required:
        if column in spec.defaults:
            continue
        rows = spark.sql(f"select {minimal}").withColumn(column, F.lit(None).cast(fields[column]))
        assert [r.violations for r in validation.append_validated(rows, spec, unchecked)[1].collect()] == [[f"{column} required"]]
    for column in spec.enums:
        if column not in spec.forced:
            rows = spark.sql(f"select {minimal}").withColumn(column, F.lit("no such value"))
            assert [r.violations for r in validation.append_validated(rows, spec, unchecked)[1].collect()] == [[f"{column} legal"]]
    for column, (low, high) in spec.ranges.items():
        values = spark.sql(f"select {minimal}").withColumn(column, F.explode(F.array(*[F.lit(v) for v in (low, high, low - 1, high + 1)])))
        good, bad = validation.append_validated(values, spec, unchecked)
        assert (good.count(), bad.count()) == ((2, 2) if low - 1 != 0 or column not in spec.falsy_to_default else (3, 1))


def one(spark, table, sql, **options):
    unchecked = {k.parent: None for k in TABLES[table].foreign_keys}
    return validation.append_validated(spark.sql(sql), table, unchecked, **options)[0].first()


def test_defaults_follow_the_listed_columns(spark):
    row = one(spark, "maintenance_tasks", "select 'u' user_id, 'n' name, 0 frequency_days, '' priority, '' category")
    assert (row.priority, row.frequency_days, row.category) == ("medium", None, None)
    row = one(spark, "important_dates", "select 'u' user_id, 't' title, date'2024-01-01' date_value, 0 reminder_days_before")
    assert (row.recurring_yearly, row.reminder_days_before) == (False, 7)
    row = one(spark, "maintenance_logs", "select 't' task_id, 'u' user_id, 0 cost", as_of="2024-01-01")
    assert (row.completed_at, row.cost) == (datetime(2024, 1, 1), None)
    row = one(spark, "recipes", "select 'u' user_id, 'n' name, 0 servings, '' notes")
    assert (row.servings, row.notes, row.tags, row.ingredients) == (0, "", [], [])
    row = one(spark, "opportunities", "select 'u' user_id, 't' title, 0 value, '' stage, '' contact_id")
    assert (row.value, row.stage, row.contact_id) == (None, "identified", None)
    row = one(spark, "opportunities", "select 'u' user_id, 't' title, 12.345 value")
    assert row.value == Decimal("12.35")
    row = one(spark, "interviews", "select 'a' application_id, 'u' user_id, 'completed' status")
    assert row.status == "scheduled"
    row = one(spark, "job_postings", "select 'c' company_id, 'u' user_id, 't' title, '' salary_currency")
    assert (row.salary_currency, row.requirements) == ("USD", [])
    row = one(spark, "shopping_list_items", "select 'milk' item, '' quantity, true purchased")
    assert (row.quantity, row.purchased) == ("1", False)
    row = one(spark, "activities", "select 'u' user_id, 't' title, '' family_member_id")
    assert row.family_member_id is None


def test_parents_must_exist_and_belong_to_the_same_user(spark, tmp_path):
    rows = spark.createDataFrame([("1", "c1", "u", "call", "s"), ("2", "c1", "v", "call", "s"), ("3", "gone", "u", "call", "s"), ("4", None, "u", "fax", "s")],
                                 "id string, contact_id string, user_id string, interaction_type string, summary string")
    parents = spark.createDataFrame([("c1", "u")], "id string, user_id string")
    good, bad = validation.append_validated(rows, "contact_interactions", {"professional_contacts": parents}, "2024-01-01", str(tmp_path / "t"))
    assert [r.id for r in good.collect()] == ["1"]
    orphan = "contact_id has no parent in professional_contacts"
    assert {r.id: r.violations for r in bad.collect()} == {"2": [orphan], "3": [orphan], "4": ["contact_id required", "interaction_type legal"]}
    key = TABLES["contact_interactions"].foreign_keys[0]
    known, lost = validation.check_keys(rows, parents, key)
    assert {r.id for r in known.collect()} == {"1", "4"} and {r.id for r in lost.collect()} == {"2", "3"}


def test_a_check_is_skipped_only_on_request(spark):
    rows = spark.sql("select 'c1' contact_id, 'u' user_id, 'call' interaction_type, 's' summary")
    with pytest.raises(ValueError, match="professional_contacts is needed"):
        validation.append_validated(rows, "contact_interactions")
    with pytest.raises(ValueError, match="has no user_id"):
        validation.append_validated(rows, "contact_interactions", {"professional_contacts": spark.sql("select 'c1' id")})
    assert validation.append_validated(rows, "contact_interactions", {"professional_contacts": None}, "2024-01-01")[0].count() == 1


def test_optional_reference_may_be_null(spark):
    parents = spark.createDataFrame([("m", "u")], "id string, user_id string")
    rows = spark.sql("select 'u' user_id, 't' title, cast(null as string) family_member_id union all select 'u', 't', 'm' union all select 'u', 't', 'x'")
    good, bad = validation.append_validated(rows, "activities", {"family_members": parents})
    assert (good.count(), bad.count()) == (2, 1)


# ── access ───────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def owned(spark):
    return spark.createDataFrame([(1, "u", "public"), (2, "u", "private"), (3, "v", "private")], "id int, user_id string, visibility string")


def seen(df):
    return {r.id for r in df.collect()}


def test_own_rows_and_service_role(owned):
    assert seen(scoped_view(owned, "companies", Principal("u"))) == {1, 2}
    assert seen(scoped_view(owned, "companies", Principal(role="service_role"))) == {1, 2, 3}
    with pytest.raises(AccessDenied):
        scoped_view(owned, "companies", Principal())


def test_household_boundary(owned):
    member = Principal(role=HOUSEHOLD_ROLE)
    assert seen(scoped_view(owned, "meal_plans", member)) == {1, 2, 3}
    assert seen(scoped_view(owned, "shopping_lists", member)) == {1, 2, 3}
    assert seen(scoped_view(owned, "shopping_lists", member, "update")) == {1, 2, 3}
    for table, op in [("thoughts", "select"), ("shopping_lists", "delete"), ("meal_plans", "update"), ("recipes", "insert"), ("companies", "select")]:
        with pytest.raises(AccessDenied):
            scoped_view(owned, table, member, op)
    assert seen(scoped_view(owned, "meal_plans", Principal("v"))) == {3}
    with pytest.raises(AccessDenied):
        scoped_view(owned, "thoughts", Principal("u"))


def test_public_or_own(owned):
    assert seen(scoped_view(owned, "visible_recipes", Principal("v"))) == {1, 3}
    assert seen(scoped_view(owned, "visible_recipes", Principal())) == {1}
    assert seen(scoped_view(owned, "visible_recipes", Principal("v"), "update")) == {3}


def test_membership_and_combined_policies(spark, owned):
    members = spark.createDataFrame([("h1", "u"), ("h2", "u"), ("h3", "v")], "household_id string, user_id string")
    lists = spark.createDataFrame([(i, f"h{i}") for i in range(1, 5)], "id int, household_id string")
    assert seen(scoped_view(lists, access.members_only(members), Principal("u"))) == {1, 2}
    assert seen(scoped_view(lists, access.members_only(members), Principal("nobody"))) == set()
    either = access.any_of(lambda who: F.col("visibility") == "public", lambda who: F.col("user_id") == F.lit(who.user_id))
    assert seen(scoped_view(owned, either, Principal("v"))) == {1, 3}
