"""Statistics, digests, weekly reviews and transcripts."""

from pyspark.sql import functions as F

from keepsake.operators import lookups, review, transcripts
from keepsake.operators import themes as themes_of
from keepsake.plans import adapters as A
from keepsake.plans.catalog import day_text, query

_TOPIC_ROWS = "SELECT id, created_at, unnest(list_distinct(topics)) AS topic FROM captures"


@query("recent_thoughts", """
  SELECT id, content FROM captures WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15'""", ("captures",))
def recent_thoughts(t):
    return lookups.recent(A.captures(t), "2024-01-15", 7).select("id", "content")


@query("browse_thoughts", """
  SELECT id FROM captures WHERE type = 'task' AND list_contains(topics, 'purchase') AND list_contains(people, 'Customer#000000008')""", ("captures",))
def browse_thoughts(t):
    return lookups.browse(A.captures(t), "task", "purchase", "customer#000000008").select("id")


@query("thought_stats", """
  , p AS (SELECT 'total' AS facet, 'all' AS value FROM captures UNION ALL SELECT 'type', type FROM captures
    UNION ALL SELECT 'source', 'slack' FROM captures UNION ALL SELECT 'topic', unnest(list_distinct(topics)) FROM captures
    UNION ALL SELECT 'person', unnest(people) FROM captures)
  SELECT facet, value, count(*) AS thoughts FROM p GROUP BY ALL""", ("captures",))
def thought_stats(t):
    return review.thought_stats(A.captures(t))


@query("thought_stats_top", """
  , p AS (SELECT 'type' AS facet, type AS value FROM captures
    UNION ALL SELECT 'topic', unnest(list_distinct(topics)) FROM captures UNION ALL SELECT 'person', unnest(people) FROM captures),
    c AS (SELECT facet, value, count(*) AS thoughts FROM p GROUP BY ALL)
  SELECT facet, value, thoughts FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY thoughts DESC, value) AS r FROM c) WHERE r <= 5""", ("captures",))
def thought_stats_top(t):
    rows = review.thought_stats(A.captures(t), 5)
    return rows.where(F.col("facet").isin("type", "topic", "person")).select("facet", "value", "thoughts")


@query("themes", f"""
  SELECT topic, count(*) AS thoughts FROM ({_TOPIC_ROWS}) WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15'
  GROUP BY topic ORDER BY thoughts DESC, topic LIMIT 5""", ("captures",))
def themes(t):
    return review.themes(A.captures(t), "2024-01-08", "2024-01-15", 5)


@query("vector_themes")
def vector_themes(t):
    """Themes by k-means over the vectors (an iterative fit; its centres have no SQL form)."""
    return review.vector_themes(A.vectors(t), n=5).groupBy("theme").agg(F.count("*").alias("thoughts"))


@query("labelled_themes")
def labelled_themes(t):
    """Bisected themes of the vectors, each with its most frequent label (an iterative fit; no SQL form)."""
    vectors = A.vectors(t)
    return themes_of.theme_labels(themes_of.bisected_themes(vectors, n=5), vectors.select("id", F.col("label").cast("string").alias("topic")))


@query("daily_digest", f"""
  , d AS (SELECT * FROM captures WHERE created_at >= TIMESTAMP '2024-01-14' AND created_at < TIMESTAMP '2024-01-15'),
    k AS (SELECT topic, count(*) AS n FROM (SELECT unnest(list_distinct(topics)) AS topic FROM d) GROUP BY topic ORDER BY n DESC, topic LIMIT 5)
  SELECT 'count' AS section, 1 AS rank, 'thoughts' AS label, count(*)::DOUBLE AS value FROM d
  UNION ALL SELECT 'topic', row_number() OVER (ORDER BY n DESC, topic), topic, n::DOUBLE FROM k""", ("captures",))
def daily_digest(t):
    return review.daily_digest(A.captures(t), "2024-01-15").withColumn("rank", F.col("rank").cast("bigint"))


@query("daily_digest_highlights", """
  , d AS (SELECT * FROM thoughts WHERE created_at >= TIMESTAMP '2024-01-14' AND created_at < TIMESTAMP '2024-01-15'),
    n AS (SELECT a.id, 1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS novelty
          FROM d a JOIN d b ON a.id <> b.id AND b.embedding IS NOT NULL WHERE a.embedding IS NOT NULL GROUP BY a.id)
  SELECT row_number() OVER (ORDER BY novelty DESC, id) AS rank, id::VARCHAR AS label, round(novelty, 6) AS value FROM n
  QUALIFY row_number() OVER (ORDER BY novelty DESC, id) <= 3""", ("thoughts",))
def daily_digest_highlights(t):
    rows = review.daily_digest(A.thoughts(t), "2024-01-15").where("section = 'highlight'")
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "label", F.round("value", 6).alias("value"))


@query("weekly_review", f"""
  , c AS (SELECT topic, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-15') AS this_week,
                 count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-15') AS last_week
          FROM ({_TOPIC_ROWS}) WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22' GROUP BY topic)
  SELECT *, CASE WHEN last_week = 0 THEN 'new' WHEN this_week = 0 THEN 'dropped' WHEN this_week > last_week THEN 'growing'
                 WHEN this_week < last_week THEN 'shrinking' ELSE 'steady' END AS trend FROM c""", ("captures",))
def weekly_review(t):
    return review.weekly_review(A.captures(t), "2024-01-22")


@query("weekly_trend", f"""
  , c AS (SELECT topic, date_trunc('week', created_at)::DATE AS week, count(*) AS captures FROM ({_TOPIC_ROWS}) GROUP BY ALL)
  SELECT topic, strftime(week, '%Y-%m-%d') AS week, c.captures, lag(c.captures) OVER (PARTITION BY topic ORDER BY c.week) AS previous FROM c""", ("captures",))
def weekly_trend(t):
    return review.weekly_trend(A.captures(t)).select("topic", day_text("week"), "captures", "previous")


@query("people_review", """
  SELECT person, count(*) AS mentions FROM (SELECT unnest(people) AS person FROM captures
    WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22')
  GROUP BY person ORDER BY mentions DESC, person LIMIT 5""", ("captures",))
def people_review(t):
    return review.people_review(A.captures(t), "2024-01-22", 5)


@query("open_loops", """
  SELECT id FROM captures WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22'
    AND (type = 'task' OR len(action_items) > 0) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-21')""", ("captures",))
def open_loops(t):
    """Everything asked of people who have not signed up since 21 January."""
    events = t.read("events")
    closed = events.join(events.where("event_type = 'signup' and ts >= '2024-01-21'").select("user_id"), "user_id", "left_semi")
    return review.open_loops(A.captures(t), closed.select(F.col("event_id").alias("thought_id")), "2024-01-22").select("id")


@query("topic_gaps", f"""
  SELECT topic, count(*) AS earlier FROM ({_TOPIC_ROWS}) WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-05'
  GROUP BY topic HAVING count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-29') = 0""", ("captures",))
def topic_gaps(t):
    return review.topic_gaps(A.captures(t), "2024-02-05", 4)


@query("transcript_tail", r"""
  , l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
                 len(string_split(text, chr(10))) AS n FROM documents)
  SELECT id, line_no, line FROM l WHERE line_no > CASE WHEN n > 20 THEN n - ceil(n * 0.3::DOUBLE) ELSE 0 END""", ("captures",))
def transcript_tail(t):
    """Tails of documents over 20 lines, and all of the shorter ones."""
    docs = t.read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return transcripts.transcript_tail(docs, min_lines=20).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("find_quotes", """
  , l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  SELECT id, line_no, line FROM l WHERE line ILIKE '%license%'""", ("captures",))
def find_quotes(t):
    docs = t.read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return transcripts.find_quotes(docs, "license").withColumn("line_no", F.col("line_no").cast("bigint"))
