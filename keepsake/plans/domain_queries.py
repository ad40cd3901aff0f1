"""Household, maintenance, calendar, meals, contacts and job search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions.dates import next_yearly, reminder_date
from keepsake.functions.order import pg_asc, pg_desc
from keepsake.operators import calendar, contacts, household, jobs, lookups, maintenance, meals
from keepsake.plans import adapters as A
from keepsake.plans.catalog import day_text, query, time_text

# ── shared filters and orders ────────────────────────────────────────────────────────────────────


@query("rows_of_one_user", "SELECT id, name FROM items WHERE user_id = 7", ("items",))
def rows_of_one_user(t):
    return lookups.for_user(A.items(t), 7).select("id", "name")


@query("lookup_by_keys", """
  SELECT k.id, i.name, count(i.id) OVER (PARTITION BY k.id) AS matches
  FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 UNION SELECT -1) k LEFT JOIN items i ON i.id = k.id""", ("items",))
def lookup_by_keys(t):
    """Items by a table of keys, one of which does not exist."""
    keys = t.read("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    keys = keys.unionByName(t.spark.range(-1, 0))
    return lookups.lookup(A.items(t), keys, ["id"]).select("id", "name", "matches")


@query("rows_with_count", """
  SELECT id, user_id, count(*) OVER (PARTITION BY user_id) AS count FROM tasks""", ("tasks",))
def rows_with_count(t):
    return lookups.with_count(A.tasks(t), ["user_id"]).select("id", "user_id", "count")


@query("null_placement_in_sorts", """
  SELECT id, notes, row_number() OVER (PARTITION BY user_id ORDER BY notes ASC NULLS LAST, id) AS up,
         row_number() OVER (PARTITION BY user_id ORDER BY notes DESC NULLS FIRST, id) AS down FROM contacts""", ("contacts",))
def null_placement_in_sorts(t):
    """Where NULL notes stand in ascending and descending order, within each owner's contacts."""
    from pyspark.sql import Window
    per = Window.partitionBy("user_id")
    return A.contacts(t).select(
        "id", "notes", F.row_number().over(per.orderBy(pg_asc("notes"), "id")).cast("bigint").alias("up"),
        F.row_number().over(per.orderBy(pg_desc("notes"), "id")).cast("bigint").alias("down"))


# ── household ────────────────────────────────────────────────────────────────────────────────────


@query("search_items", """
  SELECT id, name, category, location FROM items
  WHERE name ILIKE '%ring%' OR category ILIKE '%ring%' OR location ILIKE '%ring%'""", ("items",))
def search_items(t):
    return household.search_items(A.items(t), "ring").select("id", "name", "category", "location")


@query("list_vendors", "SELECT s_suppkey AS id, s_name AS name, 'nation ' || s_nationkey AS service_type FROM supplier WHERE 'nation ' || s_nationkey ILIKE '%nation 1%'")
def list_vendors(t):
    return household.list_vendors(A.vendors(t), "NATION 1").select("id", "name", "service_type")


@query("expiring_items", """
  SELECT id, strftime(until, '%Y-%m-%d') AS expires_on FROM items
  WHERE category <> 'PROMO' AND until BETWEEN DATE '1998-01-10' AND DATE '1998-02-09'""", ("items",))
def expiring_items(t):
    return household.expiring(A.items(t), "1998-01-10", 30).select("id", day_text("expires_on"))


@query("logs_with_vendor", """
  SELECT l_suppkey % 25 AS user_id, s_suppkey AS vendor_id, count(*) AS visits, sum(l_extendedprice::DECIMAL(10,2))::DOUBLE AS cost
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def logs_with_vendor(t):
    rows = household.logs_with_vendor(A.logs(t, "l_suppkey"), A.vendors(t))
    return rows.groupBy("user_id", "vendor_id").agg(F.count("*").alias("visits"), F.sum("cost").cast("double").alias("cost"))


@query("last_recommendation", """
  , l AS (SELECT *, l_suppkey AS vendor_id FROM (SELECT l_suppkey, l_shipdate, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_quantity::DECIMAL(12,2), l_extendedprice::DECIMAL(12,2), l_returnflag) AS id, l_returnflag FROM lineitem))
  SELECT vendor_id, s_name AS vendor_name, strftime(max(l_shipdate), '%Y-%m-%d') AS completed_at,
         arg_max(l_returnflag, (l_shipdate, id)) AS next_action
  FROM l JOIN supplier ON s_suppkey = vendor_id GROUP BY ALL""", ("tasks",))
def last_recommendation(t):
    return household.last_recommendation(A.logs(t, "l_suppkey"), A.vendors(t)).select(
        "vendor_id", "vendor_name", day_text("completed_at"), "next_action")


# ── maintenance ──────────────────────────────────────────────────────────────────────────────────


@query("upcoming_maintenance", """
  , last AS (SELECT task_id, max(completed_at) AS done FROM logs GROUP BY task_id)
  SELECT id, strftime(done + to_days(frequency_days), '%Y-%m-%d') AS next_due FROM tasks JOIN last ON task_id = id
  WHERE done + to_days(frequency_days) <= TIMESTAMP '2001-06-01' + INTERVAL 30 DAY""", ("tasks", "logs"))
def upcoming_maintenance(t):
    """Tasks due within 30 days, their due dates derived from the log."""
    from keepsake.operators.state import task_state
    return maintenance.due_within(task_state(A.tasks(t), A.logs(t)), "next_due", "2001-06-01", 30).select("id", day_text("next_due"))


@query("maintenance_history", """
  SELECT l.id, task_id, name AS task_name, category AS task_category, strftime(completed_at, '%Y-%m-%d') AS completed_at
  FROM logs l JOIN tasks t ON t.id = task_id
  WHERE name ILIKE '%ring%' AND category ILIKE '%eco%' AND completed_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""", ("tasks", "logs"))
def maintenance_history(t):
    rows = maintenance.maintenance_history(A.logs(t), A.tasks(t), name="ring", category="eco", start="1998-01-01", end="1998-12-31")
    return rows.select("id", "task_id", "task_name", "task_category", day_text("completed_at"))


@query("maintenance_history_all", """
  SELECT task_category, count(*) AS logs FROM (SELECT t.category AS task_category FROM logs l LEFT JOIN tasks t ON t.id = task_id) GROUP BY 1""", ("tasks", "logs"))
def maintenance_history_all(t):
    """Without a filter every log stays."""
    return maintenance.maintenance_history(A.logs(t), A.tasks(t)).groupBy("task_category").agg(F.count("*").alias("logs"))


@query("spend_by_category", """
  SELECT t.user_id, category, year(completed_at) AS year, sum(cost)::DOUBLE AS cost, count(*) AS visits,
         strftime(max(completed_at), '%Y-%m-%d') AS last_service
  FROM logs l JOIN tasks t ON t.id = task_id GROUP BY ALL""", ("tasks", "logs"))
def spend_by_category(t):
    return maintenance.spend(A.logs(t), A.tasks(t)).select("user_id", "category", F.col("year").cast("bigint").alias("year"),
                                                            F.col("cost").cast("double").alias("cost"), "visits", day_text("last_service"))


# ── calendar ─────────────────────────────────────────────────────────────────────────────────────


@query("week_schedule", """
  SELECT a.id, title, m.name AS member_name, relationship, start_time FROM activities a
  LEFT JOIN members m ON m.id = a.family_member_id AND m.user_id = a.user_id
  WHERE (start_date <= DATE '2024-01-15' AND (end_date >= DATE '2024-01-08' OR end_date IS NULL)) OR day_of_week IS NOT NULL""", ("activities", "members"))
def week_schedule(t):
    week = calendar.week_schedule(A.activities(t), "2024-01-08", members=A.members(t))
    return week.select("id", "title", "member_name", "relationship", "start_time")


@query("week_schedule_in_order", """
  SELECT a.id, m.name AS member_name, row_number() OVER (ORDER BY start_time NULLS LAST, a.id) AS place FROM activities a
  LEFT JOIN members m ON m.id = a.family_member_id AND m.user_id = a.user_id
  WHERE (start_date <= DATE '2024-01-15' AND (end_date >= DATE '2024-01-08' OR end_date IS NULL)) OR day_of_week IS NOT NULL""", ("activities", "members"))
def week_schedule_in_order(t):
    """The place of each row in the result as it is returned."""
    return _placed(calendar.week_schedule(A.activities(t), "2024-01-08", members=A.members(t))).select("id", "member_name", "place")


def _placed(rows):
    """Rows with ``place``, their number in the order in which a sorted result comes out."""
    return rows.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "place", F.row_number().over(Window.orderBy("_at")).cast("bigint")).drop("_at")


@query("week_schedule_strict", """
  SELECT id, title FROM activities
  WHERE (start_date <= DATE '2024-01-14') AND (end_date IS NULL OR end_date >= DATE '2024-01-08')
    AND (day_of_week IS NOT NULL OR coalesce(end_date, start_date) >= DATE '2024-01-08')""", ("activities",))
def week_schedule_strict(t):
    return calendar.week_schedule(A.activities(t), "2024-01-08", strict=True).select("id", "title")


@query("search_activities", """
  SELECT id, title FROM activities WHERE title ILIKE '%I%' AND activity_type = 'click' AND family_member_id = 8""", ("activities",))
def search_activities(t):
    return calendar.search_activities(A.activities(t), "I", "click", 8).select("id", "title")


@query("upcoming_dates", """
  SELECT o_orderkey AS id, c_name AS member_name, strftime(o_orderdate, '%Y-%m-%d') AS date_value FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'""")
def upcoming_dates(t):
    soon = calendar.between_days(A.important_dates(t), "date_value", "1998-01-01", 0, members=A.members(t))
    return soon.select("id", "member_name", day_text("date_value"))


@query("yearly_reminders", """
  , d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d FROM orders),
    n AS (SELECT id, CASE WHEN d >= DATE '1998-03-01' THEN d
      WHEN d + to_years((1998 - year(d))::INTEGER) >= DATE '1998-03-01' THEN d + to_years((1998 - year(d))::INTEGER)
      ELSE d + to_years((1999 - year(d))::INTEGER) END AS next FROM d)
  SELECT id, strftime(next, '%Y-%m-%d') AS next_on, strftime(next - INTERVAL 7 DAY, '%Y-%m-%d') AS remind_on FROM n""", ("tasks",))
def yearly_reminders(t):
    rows = A.important_dates(t).withColumn("next_on", next_yearly("date_value", "1998-03-01"))
    return rows.select("id", day_text("next_on"), F.date_format(reminder_date("next_on", 7), "yyyy-MM-dd").alias("remind_on"))


@query("expand_recurring", """
  , days AS (SELECT unnest(generate_series(DATE '2024-01-08', DATE '2024-01-21', INTERVAL 1 DAY))::DATE AS d)
  SELECT id, strftime(d, '%Y-%m-%d') AS on_date FROM activities, days
  WHERE d >= start_date AND (end_date IS NULL OR d <= end_date)
    AND CASE WHEN day_of_week IS NOT NULL THEN lower(dayname(d)) = day_of_week ELSE d <= coalesce(end_date, start_date) END""", ("activities",))
def expand_recurring(t):
    return calendar.expand_recurring(A.activities(t), "2024-01-08", "2024-01-21").select("id", day_text("on_date"))


@query("schedule_conflicts", """
  SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id
    AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts < a.ts + INTERVAL 30 MINUTE""")
def schedule_conflicts(t):
    """Half-hour intervals of the same person that overlap."""
    slots = t.read("events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("starts_at"),
                                    (F.col("ts") + F.expr("interval 30 minutes")).alias("ends_at"))
    return calendar.conflicts(slots, ["user_id"]).select("user_id", "id_a", "id_b")


@query("scaled_meal_plan", """
  , away AS (SELECT DISTINCT user_id, family_member_id FROM activities WHERE activity_type = 'travel' AND start_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'),
    home AS (SELECT m.user_id, count(*) AS members, count(*) FILTER (WHERE a.user_id IS NULL) AS at_home
             FROM members m LEFT JOIN away a ON a.user_id = m.user_id AND a.family_member_id = m.id GROUP BY m.user_id)
  SELECT p.id, members, at_home, ceil(members * at_home / members)::BIGINT AS scaled_servings
  FROM (SELECT o_orderkey AS id, o_custkey % 25 AS user_id FROM orders) p LEFT JOIN home USING (user_id)""", ("activities", "members"))
def scaled_meal_plan(t):
    """All plans set in one week, scaled to the members at home in it."""
    week = "2024-01-08"
    plans = A.plans(t).withColumn("user_id", F.pmod("user_id", F.lit(25))).withColumn("week_start", F.lit(week).cast("date"))
    occurrences = calendar.expand_recurring(A.activities(t), week, "2024-01-14")
    return calendar.scaled_plan(plans, A.members(t), occurrences, week).select("id", "members", "at_home", "scaled_servings")


# ── meals ────────────────────────────────────────────────────────────────────────────────────────


@query("search_recipes", """
  SELECT id, name FROM recipes WHERE name ILIKE '%r%' AND list_contains(tags, 'PROMO') AND ingredient = 'ring'""", ("recipes",))
def search_recipes(t):
    return meals.search_recipes(A.recipes(t), q="R", tag="PROMO", ingredient="ring").select("id", "name")


@query("browse_recipes", "SELECT id, name, cuisine, prep_time_minutes FROM recipes WHERE cuisine = 'SMALL' AND name ILIKE '%blue%'", ("recipes",))
def browse_recipes(t):
    return meals.browse_recipes(A.recipes(t), q="blue", cuisine="SMALL").select("id", "name", "cuisine", "prep_time_minutes")


@query("meal_plan_of_week", """
  SELECT p.id, day_of_week, meal_type, r.name AS recipe_name, r.cuisine AS recipe_cuisine, CASE WHEN r.id IS NOT NULL THEN 4 END AS recipe_servings
  FROM plans p LEFT JOIN recipes r ON r.id = p.recipe_id WHERE week_start = DATE '1998-01-05'""", ("plans", "recipes"))
def meal_plan_of_week(t):
    """Plans of one week; an order is cooked from the part of the same number, if there is one."""
    rows = meals.meal_plan(A.plans(t), A.recipes(t), "1998-01-05", with_servings=True)
    return rows.select("id", "day_of_week", "meal_type", "recipe_name", "recipe_cuisine", "recipe_servings")


@query("meal_plan_in_order", """
  SELECT p.id, r.name AS recipe_name, row_number() OVER (ORDER BY day_of_week NULLS LAST, meal_type NULLS LAST, p.id) AS place
  FROM plans p LEFT JOIN recipes r ON r.id = p.recipe_id WHERE week_start = DATE '1998-01-05'""", ("plans", "recipes"))
def meal_plan_in_order(t):
    return _placed(meals.meal_plan(A.plans(t), A.recipes(t), "1998-01-05")).select("id", "recipe_name", "place")


@query("shopping_list", """
  , l AS (SELECT p.user_id, p.week_start, i.name, i.unit, i.quantity, p.recipe_id,
      list_position(['monday','tuesday','wednesday','thursday','friday','saturday','sunday'], day_of_week) AS d,
      list_position(['breakfast','lunch','dinner','snack'], meal_type) AS m, p.id, l_linenumber, l_partkey, l_quantity
    FROM plans p JOIN ingredients i ON i.recipe_id = p.recipe_id)
  SELECT user_id, strftime(week_start, '%Y-%m-%d') AS week_start, name, unit,
         string_agg(quantity, ' + ' ORDER BY d, m, id, l_linenumber, l_partkey, l_quantity) AS quantity, false AS purchased,
         arg_min(recipe_id, (d, m, id, l_linenumber, l_partkey, l_quantity)) AS recipe_id
  FROM l GROUP BY user_id, week_start, name, unit""", ("plans", "ingredients"))
def shopping_list(t):
    """Shopping lists of every user and week."""
    return meals.shopping_list(A.plans(t), A.ingredients(t)).select(
        "user_id", day_text("week_start"), "name", "unit", "quantity", "purchased", "recipe_id")


@query("missing_ingredients", """
  , stock AS (SELECT DISTINCT user_id, lower(name) AS n FROM items)
  SELECT i.recipe_id, count(*) AS ingredients, count(*) FILTER (WHERE s.n IS NULL) AS missing
  FROM ingredients i LEFT JOIN stock s ON s.user_id = i.user_id % 25 AND s.n = lower(i.name) GROUP BY i.recipe_id""", ("ingredients", "items"))
def missing_ingredients(t):
    rows = A.ingredients(t).withColumn("user_id", F.pmod("user_id", F.lit(25)))
    return meals.missing_ingredients(rows, A.items(t)).groupBy("recipe_id").agg(
        F.count("*").alias("ingredients"), F.count_if(~F.col("in_stock")).alias("missing"))


@query("upcoming_plans", "SELECT id, strftime(date, '%Y-%m-%d') AS date FROM plans WHERE date >= DATE '1998-01-01' ORDER BY plans.date, id LIMIT 7", ("plans",))
def upcoming_plans(t):
    return meals.upcoming_plans(A.plans(t), "1998-01-01", 7).select("id", day_text("date"))


@query("unpurchased_items", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def unpurchased_items(t):
    items = t.read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("purchased"),
                                    F.col("o_orderdate").alias("created_at"))
    return meals.unpurchased(items).select("id")


# ── contacts ─────────────────────────────────────────────────────────────────────────────────────


@query("search_contacts", """
  SELECT id, name, company FROM contacts WHERE (name ILIKE '%mach%' OR company ILIKE '%mach%' OR notes ILIKE '%mach%')
    AND list_contains(tags, 'machinery')""", ("contacts",))
def search_contacts(t):
    return contacts.search_contacts(A.contacts(t), "mach", ["machinery"]).select("id", "name", "company")


@query("search_contacts_how_met", """
  SELECT id, name FROM contacts WHERE how_we_met ILIKE '%nation 1_%' AND list_contains(tags, 'building')""", ("contacts",))
def search_contacts_how_met(t):
    """Wildcards inside the search text stay wildcards."""
    return contacts.search_contacts(A.contacts(t), tags=["building"], how_met="nation 1_").select("id", "name")


@query("contact_history", """
  , n AS (SELECT contact_id, count(*) AS c FROM interactions GROUP BY 1),
    e AS (SELECT contact_id, 'interaction' AS kind, id AS entry_id, occurred_at AS "at", interaction_type AS detail, summary AS text FROM interactions
          UNION ALL SELECT contact_id, 'opportunity', id, created_at, stage, title FROM opportunities)
  SELECT c.id, name, coalesce(n.c, 0) AS interaction_count, kind, entry_id, strftime(e."at", '%Y-%m-%d') AS "at", detail, text
  FROM contacts c LEFT JOIN n ON n.contact_id = c.id LEFT JOIN e ON e.contact_id = c.id""", ("contacts", "interactions", "opportunities"))
def contact_history(t):
    rows = contacts.contact_history(A.contacts(t), A.interactions(t), A.opportunities(t))
    return rows.select("id", "name", "interaction_count", "kind", "entry_id", day_text("at"), "detail", "text")


@query("follow_ups", """
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS follow_up_date,
         CASE WHEN o_orderdate::DATE < DATE '1998-01-01' THEN 'overdue' ELSE 'upcoming' END AS bucket
  FROM orders WHERE o_orderdate::DATE <= DATE '1998-01-08'""")
def follow_ups(t):
    return contacts.follow_ups(A.order_contacts(t), "1998-01-01", 7).select("id", day_text("follow_up_date"), "bucket")


@query("follow_up_counts", """
  SELECT o_custkey % 25 AS user_id, count(*) FILTER (WHERE o_orderdate::DATE < DATE '1998-01-01') AS overdue_count,
         count(*) FILTER (WHERE o_orderdate::DATE >= DATE '1998-01-01') AS upcoming_count
  FROM orders WHERE o_orderdate::DATE <= DATE '1998-01-08' GROUP BY 1""")
def follow_up_counts(t):
    return contacts.follow_up_counts(A.order_contacts(t), "1998-01-01", 0)


@query("bridge_contacts", """
  SELECT sha256('contact|' || (s_suppkey % 25) || '|' || s_suppkey) AS id, s_name AS name, r_name AS company,
         'Job search - ' || CASE WHEN s_acctbal > 5000 THEN 'recruiter' ELSE 'contact' END AS how_we_met,
         'job-hunt|' || CASE WHEN s_acctbal > 5000 THEN 'recruiter' ELSE 'contact' END AS tags
  FROM supplier LEFT JOIN region ON r_regionkey = s_nationkey % 6 WHERE s_acctbal >= 0""")
def bridge_contacts(t):
    new, _ = contacts.bridge_contacts(A.job_contacts(t), A.companies(t), "2024-01-01")
    return new.select("id", "name", "company", "how_we_met", F.array_join("tags", "|").alias("tags"))


@query("bridge_links_written_back", """
  SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal < 0 THEN 'linked' ELSE sha256('contact|' || (s_suppkey % 25) || '|' || s_suppkey) END AS link
  FROM supplier""")
def bridge_links_written_back(t):
    from keepsake.operators.state import apply_patch
    rows = A.job_contacts(t)
    _, links = contacts.bridge_contacts(rows, A.companies(t), "2024-01-01")
    return apply_patch(rows, links, ["id", "user_id"]).select("id", F.col("professional_crm_contact_id").alias("link"))


@query("linked_notes", """
  SELECT doc_id % 25 AS contact_id, doc_id AS thought_id, chr(10) || chr(10) || '[Linked Thought 2024-03-01]: ' || text AS line FROM documents""")
def linked_notes(t):
    docs = t.read("documents")
    links = docs.select(F.pmod("doc_id", F.lit(25)).alias("contact_id"), F.col("doc_id").alias("thought_id"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return contacts.linked_notes(texts, links, "2024-03-01")


@query("append_linked_thoughts", """
  SELECT c.id, coalesce(notes, '') || coalesce(chr(10) || chr(10) || '[Linked Thought 2024-03-01]: ' || text, '') AS notes,
         notes IS NULL AND text IS NULL AS untouched FROM contacts c LEFT JOIN documents ON doc_id = c.id""", ("contacts",))
def append_linked_thoughts(t):
    """Each document linked to the contact of the same number."""
    docs = t.read("documents")
    links = docs.select(F.col("doc_id").alias("contact_id"), F.col("doc_id").alias("thought_id"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = contacts.append_linked_thoughts(A.contacts(t), texts, links, "2024-03-01")
    return rows.select("id", F.coalesce("notes", F.lit("")).alias("notes"), F.col("notes").isNull().alias("untouched"))


@query("thoughts_about_contacts", """
  SELECT contact_id, thought_id, rank FROM (
    SELECT c.id AS contact_id, e.id AS thought_id, row_number() OVER (PARTITION BY c.id ORDER BY e.created_at DESC, e.id) AS rank
    FROM contacts c JOIN (SELECT id, created_at, unnest(people) AS who FROM captures) e ON lower(e.who) = lower(c.name)) WHERE rank <= 3""", ("contacts", "captures"))
def thoughts_about_contacts(t):
    return contacts.thoughts_about(A.contacts(t), A.captures(t), 3).select("contact_id", "thought_id", F.col("rank").cast("bigint").alias("rank"))


@query("thoughts_about_contacts_in_text", r"""
  , texts AS (SELECT id, created_at, ' ' || trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS text FROM captures)
  , names AS (SELECT id, ' ' || trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS name FROM contacts)
  SELECT contact_id, thought_id, rank FROM (
    SELECT n.id AS contact_id, e.id AS thought_id, row_number() OVER (PARTITION BY n.id ORDER BY e.created_at DESC, e.id) AS rank
    FROM names n JOIN texts e ON contains(e.text, n.name)) WHERE rank <= 3""", ("contacts", "captures"))
def thoughts_about_contacts_in_text(t):
    """The newest captures whose people or text name a contact; also captures that the templates read no person from."""
    return contacts.thoughts_about(A.contacts(t), A.captures(t), 3, in_text=True).select(
        "contact_id", "thought_id", F.col("rank").cast("bigint").alias("rank"))


@query("opportunities_by_stage", """
  SELECT user_id, stage, count(*) AS opportunities, sum(value)::DOUBLE AS value, grouping(user_id, stage)::BIGINT AS level
  FROM opportunities GROUP BY ROLLUP (user_id, stage)""", ("opportunities",))
def opportunities_by_stage(t):
    return contacts.opportunities_by_stage(A.opportunities(t)).withColumn("value", F.col("value").cast("double"))


@query("stale_contacts", """
  , l AS (SELECT contact_id, max(occurred_at) AS last FROM interactions GROUP BY 1)
  SELECT id, name, datediff('day', last::DATE, DATE '2001-08-01') AS days_since FROM contacts LEFT JOIN l ON contact_id = id
  WHERE last IS NULL OR datediff('day', last::DATE, DATE '2001-08-01') >= 60""", ("contacts", "interactions"))
def stale_contacts(t):
    return contacts.staleness(A.contacts(t), A.interactions(t), "2001-08-01", 60).select(
        "id", "name", F.col("days_since").cast("bigint").alias("days_since"))


# ── job search ───────────────────────────────────────────────────────────────────────────────────


@query("upcoming_interviews", """
  SELECT i.id, strftime(scheduled_at, '%Y-%m-%d') AS scheduled_at, a.status AS application_status, n_name AS posting_title, r_name AS company_name
  FROM interviews i JOIN applications a ON a.id = application_id JOIN nation ON n_nationkey = job_posting_id JOIN region ON r_regionkey = n_regionkey
  WHERE i.status = 'scheduled' AND scheduled_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-15'""", ("interviews", "applications"))
def upcoming_interviews(t):
    rows = jobs.upcoming_interviews(A.interviews(t), A.applications(t), A.postings(t), A.companies(t), "1998-01-01", 0)
    return rows.select("id", day_text("scheduled_at"), "application_status", "posting_title", "company_name")


@query("application_overview", """
  , soon AS (SELECT i.user_id, count(*) AS n FROM interviews i JOIN applications a ON a.id = application_id
             WHERE i.status = 'scheduled' AND scheduled_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-08' GROUP BY 1)
  SELECT user_id, count(*) AS total_applications, count(*) FILTER (WHERE status = 'applied') AS applied,
         count(*) FILTER (WHERE status = 'offer') AS offer, count(*) FILTER (WHERE status = 'accepted') AS accepted,
         coalesce(max(n), 0) AS upcoming_interviews
  FROM applications LEFT JOIN soon USING (user_id) GROUP BY user_id""", ("interviews", "applications"))
def application_overview(t):
    rows = jobs.application_overview(A.applications(t), A.interviews(t), A.postings(t), A.companies(t), "1998-01-01")
    return rows.select("user_id", "total_applications", "applied", "offer", "accepted", "upcoming_interviews")


_STAGES = ["phone_screen", "technical", "behavioral", "system_design", "final"]


@query("interview_funnel", """
  , f AS (SELECT application_id, list(DISTINCT interview_type) AS ts FROM interviews GROUP BY 1),
    s AS (SELECT * FROM (VALUES (1, 'phone_screen', 'technical'), (2, 'technical', 'behavioral'), (3, 'behavioral', 'system_design'),
                                (4, 'system_design', 'final'), (5, 'final', NULL)) v(stage_no, stage, nxt))
  SELECT stage_no, stage, count(*) FILTER (WHERE list_contains(ts, stage)) AS reached,
         CASE WHEN nxt IS NOT NULL THEN count(*) FILTER (WHERE list_contains(ts, stage) AND list_contains(ts, nxt)) END AS converted,
         CASE WHEN nxt IS NOT NULL THEN round(count(*) FILTER (WHERE list_contains(ts, stage) AND list_contains(ts, nxt))
           / nullif(count(*) FILTER (WHERE list_contains(ts, stage)), 0), 6) END AS rate
  FROM f, s GROUP BY stage_no, stage, nxt""", ("interviews",))
def interview_funnel(t):
    return jobs.funnel(A.interviews(t), _STAGES).withColumn("rate", F.round("rate", 6))


@query("interview_performance", """
  SELECT interview_type, count(*) AS interviews, round(avg(rating), 6) AS avg_rating FROM interviews WHERE status = 'completed' GROUP BY 1""", ("interviews",))
def interview_performance(t):
    return jobs.interview_performance(A.interviews(t)).withColumn("avg_rating", F.round("avg_rating", 6))


@query("compensation", """
  SELECT p_partkey AS id, p_brand AS salary_currency, (p_retailprice::INTEGER * 100 + p_retailprice::INTEGER * 100 + p_size * 1000) / 2 AS midpoint,
         rank() OVER (PARTITION BY p_brand ORDER BY (p_retailprice::INTEGER * 100 + p_retailprice::INTEGER * 100 + p_size * 1000) / 2 DESC) AS rank_in_currency
  FROM part""")
def compensation(t):
    low = F.bround("p_retailprice").cast("int") * 100
    postings = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("salary_currency"),
                                     low.alias("salary_min"), (low + F.col("p_size") * 1000).alias("salary_max"))
    return jobs.compensation(postings).select("id", "salary_currency", "midpoint", "rank_in_currency")


@query("response_times", """
  SELECT l_suppkey AS user_id, count(*) AS answers, round(avg(d), 6) AS avg_days, quantile_cont(d, 0.5) AS median_days, round(quantile_cont(d, 0.9), 6) AS p90_days
  FROM (SELECT l_suppkey, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")
def response_times(t):
    lines = t.read("lineitem").select("l_orderkey", F.col("l_suppkey").alias("user_id"), F.to_date("l_shipdate").alias("response_date"))
    applied = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("applied_date"))
    return jobs.response_times(lines.join(applied, "l_orderkey")).select(
        "user_id", "answers", F.round("avg_days", 6).alias("avg_days"), "median_days", F.round("p90_days", 6).alias("p90_days"))
