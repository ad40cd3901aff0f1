"""Streams run to their end over the tables, compared with the batch answer."""

import uuid

from pyspark.sql import functions as F

from keepsake.operators import importer
from keepsake.plans import adapters as A
from keepsake.plans.catalog import day_text, query
from keepsake.session import fresh_path
from keepsake.sources import capture as channels
from keepsake.sources.capture import accept_events
from keepsake.streaming import capture

CHANNELS = ["purchase", "view", "click", "signup"]


class _StreamTables(A.Tables):
    """The same adapters over streams of the table files."""

    def read(self, name: str):
        # A glob path may name a single file.
        return self.spark.readStream.schema(self.schema(name)).parquet(self.path(name)[:-1] + "[t]")


def _redelivered(events):
    """Every message delivered twice, the second time three seconds later."""
    late = F.explode(F.array(F.lit(0), F.lit(3))).alias("late")
    return events.select("*", late).withColumn(
        "event_time", F.col("event_time") + F.make_dt_interval(secs=F.col("late"))).drop("late")


def _streamed_events(t):
    return A.capture_events(_StreamTables(t.spark, t.folder))


@query("capture_stream", """
  SELECT event_type AS channel, type, count(*) AS thoughts FROM captures WHERE event_type <> 'error' GROUP BY ALL""", ("captures",))
def capture_stream(t):
    """Gate, de-duplicate, tag and store every message of four channels, each delivered twice."""
    events = accept_events(_redelivered(_streamed_events(t)), CHANNELS)
    sink, state = fresh_path(t.spark, "captured"), fresh_path(t.spark, "capture-state")
    source = {"source": F.lit("slack"), "slack_ts": "ts", "channel": "channel"}
    capture.start_capture(events, sink, state, dedup=True, source=source, dim=16).awaitTermination()
    meta = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    stored = t.spark.read.parquet(sink)
    return stored.select(meta("channel"), meta("type")).groupBy("channel", "type").agg(F.count("*").alias("thoughts"))


@query("capture_stream_keeping_redeliveries", """
  SELECT event_type AS channel, 2 * count(*) AS thoughts FROM captures WHERE event_type <> 'error' GROUP BY ALL""", ("captures",))
def capture_stream_keeping_redeliveries(t):
    """Without de-duplication a redelivered message is stored again."""
    events = accept_events(_redelivered(_streamed_events(t)), CHANNELS)
    sink, state = fresh_path(t.spark, "captured"), fresh_path(t.spark, "capture-state")
    source = {"source": F.lit("slack"), "channel": "channel"}
    capture.start_capture(events, sink, state, dedup=False, source=source, dim=16).awaitTermination()
    channel = F.get_json_object("metadata", "$.channel").alias("channel")
    return t.spark.read.parquet(sink).groupBy(channel).agg(F.count("*").alias("thoughts"))


@query("dedup_retries", "SELECT channel, count(*) AS messages FROM (SELECT event_type AS channel FROM events) GROUP BY 1")
def dedup_retries(t):
    once = capture.dedup_retries(_redelivered(_streamed_events(t)), "10 minutes").select("channel", "ts", "event_time")
    kept = capture.run_to_end(once, fresh_path(t.spark, "dedup"), fresh_path(t.spark, "dedup-state"))
    return kept.groupBy("channel").agg(F.count("*").alias("messages"))


@query("apply_edits_stream", """
  SELECT event_type AS channel, user_id::VARCHAR AS message_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def apply_edits_stream(t):
    """Edits arriving as a stream; the newest version of each message remains."""
    messages = _StreamTables(t.spark, t.folder).read("events").select(
        F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("message_id"), F.col("ts").alias("edited_at"), "event_id")
    table = fresh_path(t.spark, "edits")
    capture.apply_edits(messages, table, fresh_path(t.spark, "edits-state")).awaitTermination()
    return capture.read_edited(t.spark, table).select("channel", "message_id", "event_id")


@query("daily_digest_batch_windows", """
  SELECT strftime(created_at, '%Y-%m-%d') AS window_start, topic, count(*) AS captures
  FROM (SELECT created_at, unnest(list_distinct(topics)) AS topic FROM captures) GROUP BY ALL""", ("captures",))
def daily_digest_batch_windows(t):
    return capture.windowed_digest(A.captures(t), "1 day").select(day_text("window_start"), "topic", "captures")


@query("daily_digest_stream", """
  SELECT strftime(created_at, '%Y-%m-%d') AS window_start, topic, count(*) AS captures
  FROM (SELECT created_at, unnest(list_distinct(topics)) AS topic FROM captures)
  WHERE date_trunc('day', created_at) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""", ("captures",))
def daily_digest_stream(t):
    """Daily windows of the stream; a day is emitted once the watermark has passed its end."""
    thoughts = A.captures(_StreamTables(t.spark, t.folder))
    digest = capture.windowed_digest(thoughts, "1 day", "1 hour")
    done = capture.run_to_end(digest, fresh_path(t.spark, "digest"), fresh_path(t.spark, "digest-state"))
    return done.select(day_text("window_start"), "topic", "captures")


def _payload_files(t, payload):
    """Events as payload lines in files; of every tenth event also a line that is cut off, of every fifteenth a blank one."""
    folder, k = fresh_path(t.spark, "payloads"), F.col("event_id")
    lines = A.capture_events(t).withColumn("json", F.to_json(payload)).select(F.explode(F.array_compact(F.array(
        "json", F.when(k % 10 == 0, F.expr("left(json, 40)")), F.when(k % 15 == 0, F.lit(" "))))).alias("value"))
    lines.write.text(folder)
    return folder


def _intake(t, payload, schema):
    """The folder of the intake table, filled by a stream that has ended."""
    table, state = fresh_path(t.spark, "intake"), fresh_path(t.spark, "intake-state")
    capture.start_intake(channels.payload_lines(t.spark, _payload_files(t, payload)), table, state, schema).awaitTermination()
    return table


def _slack():
    ts = F.format_string("%d.%06d", F.unix_seconds("event_time"), F.col("event_id") % 1_000_000)
    return F.struct(F.lit("event_callback").alias("type"), F.col("event_id").alias("team_seq"),
                    F.struct("type", "channel", "text", ts.alias("ts")).alias("event"))


def _discord():
    return F.struct(F.col("event_id").cast("string").alias("message_id"), F.lit("home").alias("server"), "channel",
                    F.format_string("user %d", "user_id").alias("author"), F.col("text").alias("content"),
                    F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


@query("payload_intake", """
  SELECT 'parsed' AS state, '["team_seq"]' AS rescued, count(*) AS lines FROM events
  UNION ALL SELECT 'malformed', NULL, count(*) FROM events WHERE event_id % 10 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'blank', NULL, count(*) FROM events WHERE event_id % 15 = 0 HAVING count(*) > 0""")
def payload_intake(t):
    """What became of every line of written Slack payloads."""
    table = _intake(t, _slack(), channels.SLACK_PAYLOAD)
    return t.spark.read.parquet(table).groupBy("state", F.to_json("rescued").alias("rescued")).agg(F.count(F.lit(1)).alias("lines"))


@query("slack_payload_capture", """
  SELECT event_type AS channel, type, count(*) AS thoughts FROM captures WHERE event_type <> 'error' GROUP BY ALL""", ("captures",))
def slack_payload_capture(t):
    """Slack payload files through intake, gate, de-duplication and tagging."""
    events = channels.slack_events(capture.parsed_payloads(t.spark, _intake(t, _slack(), channels.SLACK_PAYLOAD)))
    sink = fresh_path(t.spark, "captured")
    source = {"source": F.lit("slack"), "slack_ts": "ts", "channel": "channel"}
    capture.start_capture(accept_events(events, CHANNELS), sink, fresh_path(t.spark, "capture-state"), source=source, dim=16).awaitTermination()
    meta = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return t.spark.read.parquet(sink).groupBy(meta("channel"), meta("type")).agg(F.count("*").alias("thoughts"))


@query("discord_payload_capture", """
  SELECT 'discord' AS source, 'home' AS server, event_type AS channel, 'user ' || user_id AS author,
         strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, content
  FROM captures WHERE event_type IN ('view', 'signup')""", ("captures",))
def discord_payload_capture(t):
    """Discord message files through intake and capture, with the fields that the metadata keeps."""
    found = capture.parsed_payloads(t.spark, _intake(t, _discord(), channels.DISCORD_MESSAGE), channels.DISCORD_MESSAGE)
    sink = fresh_path(t.spark, "captured")
    capture.start_capture(accept_events(channels.discord_events(found), ["view", "signup"]), sink, fresh_path(t.spark, "capture-state"),
                          source=capture.discord_source(), dim=16).awaitTermination()
    meta = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("source", "server", "channel", "author", "timestamp")]
    return t.spark.read.parquet(sink).select(*meta, "content")


@query("import_incremental", """
  SELECT conv_hash, '[ChatGPT: ' || title || ' | ' || date_text || '] ' || user_text AS content FROM decisions WHERE skip_reason IS NULL""",
       ("turns", "convs", "decisions"))
def import_incremental(t):
    """Conversations written as export texts, imported by a file stream with its ledger."""
    folder, out = fresh_path(t.spark, "exports"), fresh_path(t.spark, "imported")
    one = F.struct("id", "title", F.col("create_time").cast("bigint").alias("create_time"), "is_do_not_remember",
                   F.parse_json("mapping").alias("mapping"))
    A.chat_export(t).select(F.concat(F.lit("["), F.to_json(one), F.lit("]")).alias("value")).write.text(folder)
    texts = t.spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    capture.import_incremental(texts, out, fresh_path(t.spark, "import-state"), "2024-02-01", dim=16).awaitTermination()
    return capture.imported_thoughts(t.spark, out).select("conv_hash", "content")


@query("import_incremental_partial_failure", """
  SELECT conv_hash, '[ChatGPT: ' || title || ' | ' || date_text || '] ' || user_text AS content FROM decisions WHERE skip_reason IS NULL""",
       ("turns", "convs", "decisions"))
def import_incremental_partial_failure(t):
    """Exports imported with an embedder that fails on some thoughts, then again under a new checkpoint."""
    folder, out = fresh_path(t.spark, "exports"), fresh_path(t.spark, "imported")
    one = F.struct("id", "title", F.col("create_time").cast("bigint").alias("create_time"), "is_do_not_remember",
                   F.parse_json("mapping").alias("mapping"))
    A.chat_export(t).select(F.concat(F.lit("["), F.to_json(one), F.lit("]")).alias("value")).write.text(folder)
    for embedder in (lambda texts: [None if len(x) % 2 else [1.0] for x in texts], lambda texts: [[1.0] for _ in texts]):
        texts = t.spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
        capture.import_incremental(texts, out, fresh_path(t.spark, "import-state"), "2024-02-01", embedder=embedder).awaitTermination()
    return capture.imported_thoughts(t.spark, out).select("conv_hash", "content")


@query("import_keeps_answers", """
  SELECT conv_hash, 3::BIGINT AS thoughts, 1::BIGINT AS answers FROM decisions WHERE skip_reason IS NULL""", ("turns", "convs", "decisions"))
def import_keeps_answers(t):
    """A summariser that never answers alike and an embedder that fails on some thoughts, then a second import: every
    conversation holds the thoughts of one answer."""
    folder = fresh_path(t.spark, "imported")

    def fn(title, day, text):
        call = uuid.uuid4().hex
        return [f"{k} {call}" for k in range(3)]

    for embedder in (lambda texts: [None if "] 1 " in x else [1.0] for x in texts], lambda texts: [[1.0] for _ in texts]):
        importer.run_import(A.chat_export(t), folder, "2024-02-01", fn=fn, embedder=embedder)
    stored = t.spark.read.parquet(f"{folder}/thoughts").where("outcome = 'accepted'")
    return stored.groupBy("conv_hash").agg(F.count("*").alias("thoughts"), F.countDistinct(F.element_at(F.split("content", " "), -1)).alias("answers"))
