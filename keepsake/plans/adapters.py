"""The driver's benchmark tables seen as domain tables, in Spark and in SQL.

Each domain table is a lazy projection (at most a join) of whole input tables. ``CTES`` holds the same
definitions for the SQL checks. Owners are derived from keys (``key % 25``), so that parents and
children agree without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.text import TRIVIAL_TITLE_PATTERN, conv_hash, tag_text

_TITLES = TRIVIAL_TITLE_PATTERN.replace("'", "''")  # inside SQL quotes

OWNERS = 25


class Tables:
    """The input tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def schema(self, name: str) -> T.StructType:
        """Schema of a table with its zone-less instants read as UTC timestamps."""
        found = self.spark.read.parquet(self.path(name)).schema
        return T.StructType([
            T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
            for f in found.fields])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))


def _owner(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(OWNERS)).cast("bigint")


def _person(key: str) -> Column:
    return F.format_string("Customer#%09d", F.col(key))


def _day(c: str) -> Column:
    return F.to_date(c)


# ── thoughts ─────────────────────────────────────────────────────────────────────────────────────


def thoughts(t: Tables) -> DataFrame:
    """Documents as thoughts; some have an embedding, some a quality label."""
    docs = t.read("documents")
    vectors = t.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    labels = t.read("labels")
    kind = (F.when(F.col("quality") == 1, "reference").when(F.col("toxic") == 1, "observation")
            .when(F.col("quality").isNotNull(), "idea"))
    joined = docs.join(vectors, "doc_id", "left").join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "embedding", "source", "lang",
        kind.alias("type"),
        F.to_json(F.struct("source", "lang", kind.alias("type"), F.array(F.col("lang"), F.col("source")).alias("topics")))
        .alias("metadata"),
        F.array("lang", "source").alias("topics"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.pmod(F.col("doc_id") * 7, F.lit(720)).cast("int")))
        .alias("created_at"))


def vectors(t: Tables) -> DataFrame:
    """The vector table alone, for searches that need no text."""
    return t.read("embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.pmod(F.col("vec_id") * 7, F.lit(720)).cast("int")))
        .alias("created_at"))


def query_vector(t: Tables, vec_id: int = 0) -> list[float]:
    """One vector to search with."""
    return [float(x) for x in t.read("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def capture_events(t: Tables) -> DataFrame:
    """Events as channel messages, written in the capture templates."""
    person, k = _person("user_id"), F.regexp_extract("props", r'"k": (\d+)', 1)
    value, on = F.col("value").cast("decimal(12,2)").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    event = F.col("event_id").cast("string")
    text = (F.when(F.col("event_type") == "purchase", F.concat(
                F.lit("Decision: bought for "), value, F.lit(" #purchase. Context: event "), event,
                F.lit(". Owner: "), person, F.lit(".")))
            .when(F.col("event_type") == "error", F.concat(
                F.lit("Insight: failure costs "), value, F.lit(" #error. Triggered by: event "), event, F.lit(".")))
            .when(F.col("event_type") == "view", F.concat(
                F.lit("Meeting with "), person, F.lit(" about view "), k, F.lit(". Key points: value "), value,
                F.lit(" #view. Action items: call back, send notes by "), on, F.lit(".")))
            .when(F.col("event_type") == "click", F.concat(
                F.lit("Saving from browser: click "), k, F.lit(" worth "), value, F.lit(" #click.")))
            .otherwise(F.concat(person, F.lit(" — signed up on "), on, F.lit(" #signup."))))
    return t.read("events").select(
        F.lit("message").alias("type"), F.lit(None).cast("string").alias("subtype"),
        F.lit(None).cast("string").alias("bot_id"), F.col("event_type").alias("channel"),
        text.alias("text"), event.alias("ts"), F.col("ts").alias("event_time"), "event_id", "user_id")


def captures(t: Tables) -> DataFrame:
    """Captured events as tagged thoughts."""
    return capture_events(t).withColumn("tags", tag_text("text")).select(
        F.col("event_id").alias("id"), F.col("text").alias("content"), F.lit("slack").alias("source"),
        "tags.type", "tags.topics", "tags.people", "tags.action_items", "tags.dates_mentioned",
        F.col("event_time").alias("created_at"))


def chat_export(t: Tables) -> DataFrame:
    """Conversations as an export reader gives them: one row and one message tree per conversation.

    The tree is one JSON value per conversation in the source format, hence the only grouping here.
    """
    turns = t.read("conversations")
    node = F.struct(
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"),
        F.array((F.col("turn") + 1).cast("string")).alias("children"),
        F.struct(F.struct("role").alias("author"),
                 F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
        .alias("message"))
    trees = turns.groupBy("conv_id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string").alias("k"), node.alias("v")))))
        .alias("mapping"),
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"))
    seconds = F.lit(1704067200) + F.col("conv_id") * 3600
    return trees.select(
        conv_hash("title", seconds.cast("string")).alias("conv_hash"), F.lit("export").alias("file"),
        F.col("conv_id").alias("position"), F.col("conv_id").cast("string").alias("id"), "title",
        F.col("title").alias("title_shown"), seconds.cast("double").alias("create_time"),
        F.lit(False).alias("is_do_not_remember"), "mapping")


# ── contacts ─────────────────────────────────────────────────────────────────────────────────────


def contacts(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("id"), _owner("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("company"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("met in nation "), F.col("c_nationkey").cast("string")).alias("how_we_met"),
        F.array(F.lower("c_mktsegment")).alias("tags"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("balance "), F.col("c_acctbal").cast("decimal(12,2)").cast("string")))
        .alias("notes"),
        F.lit(None).cast("timestamp").alias("last_contacted"),
        F.lit("1995-01-01").cast("timestamp").alias("created_at"))


def interactions(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"), _owner("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("interaction_type"), F.col("o_orderdate").alias("occurred_at"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("summary"),
        F.col("o_orderdate").alias("created_at"))


def opportunities(t: Tables) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "P", "proposal").when(F.col("o_orderstatus") == "O", "negotiation").otherwise("won")
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"), _owner("o_custkey").alias("user_id"),
        F.concat(F.lit("deal "), F.col("o_orderkey").cast("string")).alias("title"), stage.alias("stage"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("value"), F.col("o_orderdate").alias("created_at"))


def order_contacts(t: Tables) -> DataFrame:
    """Orders as contacts with a follow-up day."""
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), _owner("o_custkey").alias("user_id"), _day("o_orderdate").alias("follow_up_date"))


# ── job search ───────────────────────────────────────────────────────────────────────────────────


def companies(t: Tables) -> DataFrame:
    return t.read("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))


def postings(t: Tables) -> DataFrame:
    return t.read("nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("company_id"),
        F.col("n_name").alias("title"))


def applications(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    status = (F.when(seg == "HOUSEHOLD", "applied").when(seg == "MACHINERY", "screening")
              .when(seg == "FURNITURE", "interviewing").when(seg == "BUILDING", "offer").otherwise("rejected"))
    return t.read("customer").select(
        F.col("c_custkey").alias("id"), _owner("c_custkey").alias("user_id"),
        F.col("c_nationkey").cast("bigint").alias("job_posting_id"), status.alias("status"))


def interviews(t: Tables) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = (F.when(p == "1-URGENT", "phone_screen").when(p == "2-HIGH", "technical").when(p == "3-MEDIUM", "behavioral")
            .when(p == "4-NOT SPECIFIED", "system_design").otherwise("final"))
    status = F.when(s == "O", "scheduled").when(s == "F", "completed").otherwise("cancelled")
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), _owner("o_custkey").alias("user_id"), F.col("o_custkey").alias("application_id"),
        kind.alias("interview_type"), F.col("o_orderdate").alias("scheduled_at"), status.alias("status"),
        F.lit(None).cast("string").alias("feedback"),
        (F.pmod(F.floor("o_totalprice"), F.lit(5)) + 1).cast("int").alias("rating"))


def job_contacts(t: Tables) -> DataFrame:
    return t.read("supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), _owner("s_suppkey").cast("string").alias("user_id"),
        F.pmod(F.col("s_nationkey"), F.lit(6)).cast("bigint").alias("company_id"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("linkedin_url"),
        F.when(F.col("s_acctbal") > 5000, "recruiter").alias("role_in_process"),
        F.when(F.col("s_acctbal") < 0, F.lit("linked")).alias("professional_crm_contact_id"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("timestamp").alias("last_contacted"))


# ── home ─────────────────────────────────────────────────────────────────────────────────────────


def tasks(t: Tables) -> DataFrame:
    return t.read("part").select(
        F.col("p_partkey").alias("id"), _owner("p_partkey").alias("user_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_size").alias("frequency_days"),
        F.lit(None).cast("timestamp").alias("last_completed"), F.lit(None).cast("timestamp").alias("next_due"))


def logs(t: Tables, owner: str = "l_partkey") -> DataFrame:
    """Line items as maintenance logs; the id spells out the whole row, since keys repeat."""
    text = lambda c, kind: F.col(c).cast(kind).cast("string")
    return t.read("lineitem").select(
        F.concat_ws("-", text("l_orderkey", "bigint"), text("l_linenumber", "bigint"), text("l_partkey", "bigint"),
                    text("l_suppkey", "bigint"), text("l_quantity", "decimal(12,2)"),
                    text("l_extendedprice", "decimal(12,2)"), F.col("l_returnflag")).alias("id"),
        F.col("l_partkey").alias("task_id"), _owner(owner).alias("user_id"), F.col("l_shipdate").alias("completed_at"),
        F.format_string("SUPPLIER#%09d", F.col("l_suppkey")).alias("performed_by"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("cost"), F.col("l_returnflag").alias("next_action"))


def items(t: Tables) -> DataFrame:
    until = F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size"))
    return t.read("part").select(
        F.col("p_partkey").alias("id"), _owner("p_partkey").alias("user_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("location"),
        F.when(F.col("p_type") == "PROMO", F.lit("not json"))
        .otherwise(F.concat(F.lit('{"warranty_until": "'), until.cast("string"), F.lit('"}'))).alias("details"),
        F.lit(None).cast("string").alias("notes"), F.lit("1995-01-01").cast("timestamp").alias("created_at"))


def vendors(t: Tables) -> DataFrame:
    return t.read("supplier").select(
        F.col("s_suppkey").alias("id"), _owner("s_suppkey").alias("user_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("service_type"),
        F.lit(None).cast("string").alias("phone"))


def members(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("id"), _owner("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
        F.lower("c_mktsegment").alias("relationship"))


def activities(t: Tables) -> DataFrame:
    """Events as activities: clicks recur weekly, views are open-ended, signups are for the whole family."""
    e, d = F.col("event_type"), F.to_date("ts")
    return t.read("events").select(
        F.col("event_id").alias("id"), _owner("user_id").alias("user_id"),
        F.when(e != "signup", F.col("user_id")).alias("family_member_id"), e.alias("title"),
        F.when(e == "purchase", "travel").otherwise(e).alias("activity_type"),
        F.when(e == "click", F.lower(F.date_format("ts", "EEEE"))).alias("day_of_week"),
        F.date_format("ts", "HH:mm").alias("start_time"), d.alias("start_date"),
        F.when(e == "error", F.date_add(d, 2)).when(e == "purchase", d).alias("end_date"))


def important_dates(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), _owner("o_custkey").alias("user_id"), F.col("o_custkey").alias("family_member_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), _day("o_orderdate").alias("date_value"))


def plans(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start"),
        F.lower(F.date_format("o_orderdate", "EEEE")).alias("day_of_week"),
        F.when(s == "O", "dinner").when(s == "F", "lunch").otherwise("breakfast").alias("meal_type"),
        F.col("o_orderkey").alias("recipe_id"), F.lit(None).cast("int").alias("servings"), _day("o_orderdate").alias("date"))


def ingredients(t: Tables) -> DataFrame:
    """Order lines as ingredient rows of the order's recipe."""
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    owners = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(parts, "l_partkey").join(owners, "l_orderkey").select(
        F.col("l_orderkey").alias("recipe_id"), F.col("o_custkey").alias("user_id"),
        F.struct("l_linenumber", "l_partkey", "l_quantity").alias("pos"), F.col("p_name").alias("name"),
        F.col("p_type").alias("unit"), F.col("l_quantity").cast("int").cast("string").alias("quantity"))


def recipes(t: Tables) -> DataFrame:
    """Parts as recipes with one ingredient."""
    return t.read("part").select(
        F.col("p_partkey").alias("id"), _owner("p_partkey").alias("user_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("cuisine"), F.col("p_size").alias("prep_time_minutes"), F.lit(None).cast("int").alias("cook_time_minutes"),
        F.lit(4).alias("servings"), F.array(F.struct(F.element_at(F.split("p_name", " "), 2).alias("name"),
                                                     F.col("p_size").cast("string").alias("quantity"),
                                                     F.col("p_brand").alias("unit"))).alias("ingredients"),
        F.array("p_brand", "p_type").alias("tags"), F.lit(None).cast("int").alias("rating"),
        F.when(F.col("p_type") == "PROMO", "public").otherwise("private").alias("visibility"),
        F.lit("1995-01-01").cast("timestamp").alias("created_at"))


# ── the same in SQL ──────────────────────────────────────────────────────────────────────────────

CTES: dict[str, str] = {
    "thoughts": """
      SELECT d.doc_id AS id, d.text AS content, e.embedding, d.source, d.lang,
             CASE WHEN l.quality = 1 THEN 'reference' WHEN l.toxic = 1 THEN 'observation'
                  WHEN l.quality IS NOT NULL THEN 'idea' END AS type,
             [d.lang, d.source] AS topics,
             TIMESTAMP '2024-01-01' + to_hours(((d.doc_id * 7) % 720)::INTEGER) AS created_at
      FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "vectors": """
      SELECT vec_id AS id, embedding, label,
             TIMESTAMP '2024-01-01' + to_hours(((vec_id * 7) % 720)::INTEGER) AS created_at FROM embeddings""",
    "captures": r"""
      SELECT event_id AS id, event_type, user_id, ts AS created_at, person, k, amount, day,
        CASE event_type WHEN 'purchase' THEN 'task' WHEN 'error' THEN 'idea' WHEN 'view' THEN 'observation'
             WHEN 'click' THEN 'reference' ELSE 'person_note' END AS type,
        CASE event_type WHEN 'view' THEN ['view ' || k, 'view'] ELSE [event_type] END AS topics,
        CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN [person] ELSE [] END AS people,
        CASE event_type WHEN 'view' THEN ['call back', 'send notes by ' || day] ELSE [] END AS action_items,
        CASE WHEN event_type IN ('view', 'signup') THEN [day] ELSE [] END AS dates_mentioned,
        CASE event_type
          WHEN 'purchase' THEN 'Decision: bought for ' || amount || ' #purchase. Context: event ' || event_id || '. Owner: ' || person || '.'
          WHEN 'error' THEN 'Insight: failure costs ' || amount || ' #error. Triggered by: event ' || event_id || '.'
          WHEN 'view' THEN 'Meeting with ' || person || ' about view ' || k || '. Key points: value ' || amount
               || ' #view. Action items: call back, send notes by ' || day || '.'
          WHEN 'click' THEN 'Saving from browser: click ' || k || ' worth ' || amount || ' #click.'
          ELSE person || ' — signed up on ' || day || ' #signup.' END AS content
      FROM (SELECT *, 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS person,
                   regexp_extract(props, '"k": (\d+)', 1) AS k, value::DECIMAL(12,2)::VARCHAR AS amount,
                   strftime(ts, '%Y-%m-%d') AS day FROM events)""",
    "turns": r"""
      SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
             len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM conversations""",
    "convs": """
      SELECT conv_id, max(title) AS title, count(*) FILTER (WHERE text <> '') AS message_count,
             coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn)
                      FILTER (WHERE role = 'user' AND text <> ''), '') AS user_text,
             coalesce(sum(words) FILTER (WHERE role = 'user'), 0)
               + greatest(count(*) FILTER (WHERE role = 'user' AND text <> '') - 1, 0) AS user_words,
             strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER), '%Y-%m-%d') AS date_text,
             sha256(max(title) || '|' || (1704067200 + conv_id * 3600)::VARCHAR)[1:16] AS conv_hash
      FROM (SELECT t.*, c.text AS title FROM turns t LEFT JOIN conversations c
            ON c.conv_id = t.conv_id AND c.turn = 0) GROUP BY conv_id""",
    "decisions": rf"""
      SELECT *, CASE WHEN message_count < 4 THEN 'too_few_messages'
        WHEN regexp_matches(title, '(?i){_TITLES}') THEN 'skip_title'
        WHEN user_words < 20 THEN 'too_little_text' END AS skip_reason FROM convs""",
    "contacts": """
      SELECT c_custkey AS id, c_custkey % 25 AS user_id, c_name AS name, c_mktsegment AS company,
             'met in nation ' || c_nationkey AS how_we_met, [lower(c_mktsegment)] AS tags,
             CASE WHEN c_acctbal > 0 THEN 'balance ' || c_acctbal::DECIMAL(12,2)::VARCHAR END AS notes FROM customer""",
    "interactions": """
      SELECT o_orderkey AS id, o_custkey AS contact_id, o_custkey % 25 AS user_id, o_orderpriority AS interaction_type,
             o_orderdate AS occurred_at, 'order ' || o_orderkey AS summary, o_orderdate AS created_at FROM orders""",
    "opportunities": """
      SELECT o_orderkey AS id, o_custkey AS contact_id, o_custkey % 25 AS user_id, 'deal ' || o_orderkey AS title,
             CASE o_orderstatus WHEN 'P' THEN 'proposal' WHEN 'O' THEN 'negotiation' ELSE 'won' END AS stage,
             o_totalprice::DECIMAL(12,2) AS value, o_orderdate AS created_at FROM orders""",
    "applications": """
      SELECT c_custkey AS id, c_custkey % 25 AS user_id, c_nationkey AS job_posting_id,
             CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'applied' WHEN 'MACHINERY' THEN 'screening' WHEN 'FURNITURE' THEN 'interviewing'
                  WHEN 'BUILDING' THEN 'offer' ELSE 'rejected' END AS status FROM customer""",
    "interviews": """
      SELECT o_orderkey AS id, o_custkey % 25 AS user_id, o_custkey AS application_id,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'phone_screen' WHEN '2-HIGH' THEN 'technical' WHEN '3-MEDIUM' THEN 'behavioral'
                  WHEN '4-NOT SPECIFIED' THEN 'system_design' ELSE 'final' END AS interview_type,
             o_orderdate AS scheduled_at,
             CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status,
             (floor(o_totalprice)::BIGINT % 5 + 1)::INTEGER AS rating FROM orders""",
    "logs": """
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DECIMAL(12,2), l_extendedprice::DECIMAL(12,2), l_returnflag) AS id,
             l_partkey AS task_id, l_partkey % 25 AS user_id, l_shipdate AS completed_at,
             'SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0') AS performed_by, l_extendedprice::DECIMAL(10,2) AS cost, l_returnflag AS next_action
      FROM lineitem""",
    "tasks": """
      SELECT p_partkey AS id, p_partkey % 25 AS user_id, p_name AS name, p_type AS category, p_size AS frequency_days FROM part""",
    "items": """
      SELECT p_partkey AS id, p_partkey % 25 AS user_id, p_name AS name, p_type AS category, p_brand AS location,
             DATE '1998-01-01' + p_size AS until FROM part""",
    "members": """
      SELECT c_custkey AS id, c_custkey % 25 AS user_id, c_name AS name, lower(c_mktsegment) AS relationship FROM customer""",
    "activities": """
      SELECT event_id AS id, user_id % 25 AS user_id, CASE WHEN event_type <> 'signup' THEN user_id END AS family_member_id,
             event_type AS title, CASE WHEN event_type = 'purchase' THEN 'travel' ELSE event_type END AS activity_type,
             CASE WHEN event_type = 'click' THEN lower(dayname(ts)) END AS day_of_week, strftime(ts, '%H:%M') AS start_time,
             ts::DATE AS start_date,
             CASE event_type WHEN 'error' THEN ts::DATE + 2 WHEN 'purchase' THEN ts::DATE END AS end_date FROM events""",
    "plans": """
      SELECT o_orderkey AS id, o_custkey AS user_id, date_trunc('week', o_orderdate)::DATE AS week_start,
             lower(dayname(o_orderdate)) AS day_of_week,
             CASE o_orderstatus WHEN 'O' THEN 'dinner' WHEN 'F' THEN 'lunch' ELSE 'breakfast' END AS meal_type,
             o_orderkey AS recipe_id, o_orderdate::DATE AS date FROM orders""",
    "ingredients": """
      SELECT l_orderkey AS recipe_id, o_custkey AS user_id, l_linenumber, l_partkey, l_quantity, p_name AS name, p_type AS unit,
             l_quantity::INTEGER::VARCHAR AS quantity
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""",
    "recipes": """
      SELECT p_partkey AS id, p_partkey % 25 AS user_id, p_name AS name, p_type AS cuisine, p_size AS prep_time_minutes,
             split_part(p_name, ' ', 2) AS ingredient, [p_brand, p_type] AS tags,
             CASE WHEN p_type = 'PROMO' THEN 'public' ELSE 'private' END AS visibility FROM part""",
}


def with_tables(*names: str) -> str:
    """A WITH clause of the named domain tables."""
    return "WITH " + ", ".join(f"{name} AS ({CTES[name]})" for name in names) + " "
