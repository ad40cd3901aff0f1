"""State from logs, upserts, patches, validation and access policies."""

from pyspark.sql import functions as F

from keepsake.operators import access, state, validation
from keepsake.plans import adapters as A
from keepsake.plans.catalog import day_text, query

@query("task_state", """
  SELECT t.id, strftime(done, '%Y-%m-%d') AS last_completed, strftime(done + to_days(frequency_days), '%Y-%m-%d') AS next_due
  FROM tasks t LEFT JOIN (SELECT task_id, max(completed_at) AS done FROM logs GROUP BY 1) ON task_id = t.id""", ("tasks", "logs"))
def task_state(t):
    return state.task_state(A.tasks(t), A.logs(t)).select("id", day_text("last_completed"), day_text("next_due"))


@query("task_state_by_insertion", """
  SELECT c_custkey AS id, strftime(done, '%Y-%m-%d') AS last_completed, strftime(done + to_days(c_nationkey), '%Y-%m-%d') AS next_due
  FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderdate, o_orderkey) AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def task_state_by_insertion(t):
    """Orders as logs of customers: the last inserted one wins, so the state may move back in time."""
    tasks = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("frequency_days"),
                                      F.lit(None).cast("timestamp").alias("last_completed"), F.lit(None).cast("timestamp").alias("next_due"))
    logs = t.read("orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("completed_at"),
                                   F.col("o_orderkey").alias("ingest_seq"))
    return state.task_state(tasks, logs).select("id", day_text("last_completed"), day_text("next_due"))


@query("last_contacted", """
  SELECT c.id, strftime("at", '%Y-%m-%d') AS last_contacted FROM contacts c
  LEFT JOIN (SELECT contact_id, arg_max(occurred_at, (created_at, id)) AS "at" FROM interactions GROUP BY 1) ON contact_id = c.id""", ("contacts", "interactions"))
def last_contacted(t):
    return state.last_contacted(A.contacts(t), A.interactions(t)).select("id", day_text("last_contacted"))


@query("patch_recipes", """
  SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name,
         CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS prep_time_minutes,
         CASE WHEN p_size > 25 THEN '2024-02-01' ELSE '1995-01-01' END AS updated_at FROM part""")
def patch_recipes(t):
    """Two patches of every recipe that takes over 25 minutes: a new name, then a cleared time."""
    rows = A.recipes(t).select("id", "user_id", "name", "prep_time_minutes", F.col("created_at").alias("updated_at"))
    long = rows.where("prep_time_minutes > 25")
    nothing = F.lit(None).cast("int").alias("prep_time_minutes")
    names = long.select("id", "user_id", F.upper("name").alias("name"), nothing, F.array(F.lit("name")).alias("fields"), F.lit(1).alias("seq"))
    times = long.select("id", "user_id", F.lit(None).cast("string").alias("name"), nothing,
                        F.array(F.lit("prep_time_minutes")).alias("fields"), F.lit(2).alias("seq"))
    out = state.apply_patch(rows, names.unionByName(times), ["id", "user_id"], as_of="2024-02-01", seq="seq")
    return out.select("id", "name", "prep_time_minutes", day_text("updated_at"))


@query("complete_interviews", """
  SELECT id, CASE WHEN status = 'scheduled' THEN 'completed' ELSE status END AS status,
         CASE WHEN status = 'scheduled' THEN 'went well' END AS feedback FROM interviews""", ("interviews",))
def complete_interviews(t):
    rows = A.interviews(t)
    notes = rows.where("status = 'scheduled'").select("id", "user_id", F.lit("went well").alias("feedback"), F.lit(4).alias("rating"))
    return state.complete_interviews(rows, notes).select("id", "status", "feedback")


@query("upsert_shopping_lists", """
  , old AS (SELECT user_id, week_start, min(id) AS id, count(*) AS n FROM plans WHERE date < DATE '1998-06-03' GROUP BY ALL),
    new AS (SELECT user_id, week_start, min(id) AS id, count(*) AS n FROM plans WHERE week_start >= DATE '1998-05-25' GROUP BY ALL)
  SELECT coalesce(old.id, new.id) AS id, user_id, strftime(week_start, '%Y-%m-%d') AS week_start, coalesce(new.n, old.n) AS n
  FROM old FULL JOIN new USING (user_id, week_start)""", ("plans",))
def upsert_shopping_lists(t):
    """Lists made in June 1998 laid over those known before; a replaced list keeps its id."""
    lists = lambda rows: rows.groupBy("user_id", "week_start").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    plans = A.plans(t)
    old, new = lists(plans.where("date < '1998-06-03'")), lists(plans.where("week_start >= '1998-05-25'"))
    return state.upsert_latest(old, new, ["user_id", "week_start"], keep=("id",)).select("id", "user_id", day_text("week_start"), "n")


@query("set_purchased", """
  SELECT recipe_id AS id, user_id, count(*) AS items, count(*) FILTER (WHERE name LIKE 'blue%') AS purchased
  FROM ingredients GROUP BY ALL""", ("ingredients",))
def set_purchased(t):
    """Every blue item on every order's list is marked; an order bounds its list."""
    lines = A.ingredients(t)
    item = F.struct("name", "quantity", "unit", F.lit(False).alias("purchased"), F.col("recipe_id").cast("string").alias("recipe_id"))
    lists = lines.groupBy(F.col("recipe_id").alias("id"), "user_id").agg(F.collect_list(item).alias("items"))
    changes = lines.where(F.col("name").like("blue%")).select(
        F.col("recipe_id").alias("id"), "user_id", F.col("name").alias("item_name"), F.lit(True).alias("purchased"))
    out = state.set_purchased(lists, changes)
    return out.select("id", "user_id", F.size("items").cast("bigint").alias("items"),
                      F.size(F.filter("items", lambda i: i["purchased"])).cast("bigint").alias("purchased"))


@query("set_purchased_by_id", "SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_totalprice > 300000 AS purchased FROM orders")
def set_purchased_by_id(t):
    orders = t.read("orders")
    items = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("purchased"))
    patch = orders.where("o_totalprice > 300000").select(
        F.col("o_orderkey").alias("id"), F.lit(True).alias("purchased"), F.array(F.lit("purchased")).alias("fields"))
    return state.apply_patch(items, patch, ["id"])


@query("cascade_delete", """
  SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""")
def cascade_delete(t):
    """Interactions left after contacts in debt were deleted."""
    gone = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return state.cascade(A.interactions(t), gone, ("contact_id", "id")).select("id")


@query("cascade_two_levels", """
  SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE c_acctbal >= 0 GROUP BY 1""")
def cascade_two_levels(t):
    """Deleting contacts removes their orders, which removes the orders' lines."""
    gone = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    orders = A.interactions(t)
    dead = orders.join(gone, F.col("contact_id") == gone["id"], "left_semi").select("id")
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("flag"))
    return state.cascade(lines, dead, ("order_id", "id")).groupBy("flag").agg(F.count("*").alias("lines"))


@query("cascade_set_null", """
  SELECT o_orderkey AS id, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS contact_id FROM orders JOIN customer ON c_custkey = o_custkey""")
def cascade_set_null(t):
    gone = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return state.cascade(A.opportunities(t), gone, ("contact_id", "id"), "set_null").select("id", "contact_id")


@query("latest_edit", """
  SELECT event_type AS channel, user_id::VARCHAR AS message_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def latest_edit(t):
    """The newest event of each user and channel, as versions of one message."""
    messages = t.read("events").select(F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("message_id"),
                                       F.col("ts").alias("edited_at"), "event_id")
    return state.latest_edit(messages).select("channel", "message_id", "event_id")


@query("merge_inventories", """
  SELECT text, min(pass) AS pass, arg_min(doc_id, (pass, doc_id)) AS doc_id FROM (
    SELECT text, doc_id, 1 AS pass FROM documents WHERE lang = 'en' UNION ALL SELECT text, doc_id, 2 FROM documents) GROUP BY text""")
def merge_inventories(t):
    """English documents as a first pass, all documents as the second; equal texts are one entry."""
    docs = t.read("documents")
    one = docs.where("lang = 'en'").select("text", F.lit(1).alias("pass"), "doc_id")
    two = docs.select("text", F.lit(2).alias("pass"), "doc_id")
    return state.merge_inventories(one, two, ["text"])


@query("duplicate_content", """
  SELECT min(doc_id) AS first_id, count(*) - 1 AS extra_copies FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_content(t):
    return (t.read("documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("extra_copies"))
            .where("extra_copies > 0").select("first_id", "extra_copies"))


# ── validation ───────────────────────────────────────────────────────────────────────────────────


def _vendor_rows(t):
    return t.read("part").select(
        F.col("p_partkey").cast("string").alias("id"), F.pmod("p_partkey", F.lit(25)).cast("string").alias("user_id"),
        F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("name"), F.lit("").alias("phone"),
        (F.col("p_size") - 20).alias("rating"))


@query("load_vendors_accepted", """
  SELECT p_partkey::VARCHAR AS id, p_name AS name, NULL AS phone, nullif(p_size - 20, 0) AS rating FROM part
  WHERE p_type <> 'PROMO' AND (p_size = 20 OR p_size BETWEEN 21 AND 25)""")
def load_vendors_accepted(t):
    good, _ = validation.append_validated(_vendor_rows(t), "household_vendors")
    return good.select("id", "name", "phone", "rating")


@query("load_vendors_rejected", """
  SELECT p_partkey::VARCHAR AS id, concat_ws(', ', CASE WHEN p_type = 'PROMO' THEN 'name required' END,
         CASE WHEN p_size - 20 NOT BETWEEN 0 AND 5 THEN 'rating in range' END) AS violations FROM part
  WHERE p_type = 'PROMO' OR p_size - 20 NOT BETWEEN 0 AND 5""")
def load_vendors_rejected(t):
    _, bad = validation.append_validated(_vendor_rows(t), "household_vendors")
    return bad.select("id", F.array_join("violations", ", ").alias("violations"))


@query("load_opportunities", """
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'stage legal' WHEN c_acctbal < 0 THEN 'contact_id has no parent in professional_contacts' ELSE '' END AS violations,
         count(*) AS loaded, sum(nullif(o_totalprice::DECIMAL(12,2), 0))::DOUBLE AS value
  FROM (SELECT *, CASE WHEN o_orderstatus = 'P' AND c_acctbal < 0 THEN 1 ELSE 0 END AS twice FROM orders JOIN customer ON c_custkey = o_custkey)
  WHERE twice = 0 GROUP BY 1
  UNION ALL SELECT 'stage legal, contact_id has no parent in professional_contacts', count(*), sum(o_totalprice::DECIMAL(12,2))::DOUBLE
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_acctbal < 0 HAVING count(*) > 0""")
def load_opportunities(t):
    """Orders as opportunities: a missing stage gets the default, an unknown one and a missing parent are violations."""
    rows = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.pmod("o_custkey", F.lit(25)).cast("string").alias("user_id"),
        F.col("o_custkey").cast("string").alias("contact_id"), F.lit("deal").alias("title"),
        F.when(F.col("o_orderstatus") == "P", "P").when(F.col("o_orderstatus") == "O", "").otherwise("won").alias("stage"),
        F.col("o_totalprice").alias("value"))
    parents = A.contacts(t).join(t.read("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id")), "id", "left_semi")
    parents = parents.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"))
    checked = validation.checked(rows, "opportunities", {"professional_contacts": parents})
    return checked.groupBy(F.array_join("violations", ", ").alias("violations")).agg(
        F.count("*").alias("loaded"), F.sum("value").cast("double").alias("value"))


@query("orphans", "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def orphans(t):
    """Interactions whose contact is not among the parents (all but the building segment)."""
    from keepsake.sources.tables import ForeignKey
    parents = A.contacts(t).where("company <> 'BUILDING'")
    _, lost = validation.check_keys(A.interactions(t), parents, ForeignKey(("contact_id", "user_id"), "professional_contacts", ("id", "user_id")))
    return lost.select("id")


# ── access ───────────────────────────────────────────────────────────────────────────────────────


@query("scoped_own_rows", "SELECT id FROM contacts WHERE user_id = 7", ("contacts",))
def scoped_own_rows(t):
    return access.scoped_view(A.contacts(t), "professional_contacts", access.Principal("7")).select("id")


@query("scoped_membership", """
  SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (7))""")
def scoped_membership(t):
    """Shared lists of the households one user belongs to."""
    members = t.read("customer").select(F.col("c_nationkey").alias("household_id"), F.col("c_custkey").cast("string").alias("user_id"))
    lists = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("household_id"))
    return access.scoped_view(lists, access.members_only(members), access.Principal("7")).select("id")


@query("scoped_public_or_own", "SELECT id FROM recipes WHERE visibility = 'public' OR user_id = 7", ("recipes",))
def scoped_public_or_own(t):
    return access.scoped_view(A.recipes(t), "visible_recipes", access.Principal("7")).select("id")


@query("scoped_any_policy", "SELECT id FROM recipes WHERE visibility = 'public' OR user_id = 7 OR cuisine = 'SMALL'", ("recipes",))
def scoped_any_policy(t):
    policy = access.any_of(lambda who: F.col("visibility") == "public", lambda who: F.col("user_id") == F.lit(who.user_id),
                           lambda who: F.col("cuisine") == "SMALL")
    return access.scoped_view(A.recipes(t), policy, access.Principal("7")).select("id")


@query("scoped_household_role", "SELECT id, meal_type FROM plans", ("plans",))
def scoped_household_role(t):
    """Household credentials read every meal plan."""
    return access.scoped_view(A.plans(t), "meal_plans", access.Principal(role=access.HOUSEHOLD_ROLE)).select("id", "meal_type")
