"""Chat import and other sources."""

import json
import uuid
import zipfile

from pyspark import TaskContext
from pyspark.sql import functions as F

from keepsake.functions.text import merge_metadata, preview
from keepsake.operators import hooks, importer
from keepsake.plans import adapters as A
from keepsake.plans.catalog import query, time_text
from keepsake.session import fresh_path
from keepsake.sources import chat_export, imports, sinks
from keepsake.sources.json_arrays import located


def _decisions(t, **options):
    return importer.decision_table(A.chat_export(t), fresh_path(t.spark, "decisions"), **options)


def _ledger(t):
    """A ledger that knows every conversation with a system message."""
    known = t.read("conversations").where(F.col("role") == "system").select("conv_id").distinct()
    return A.chat_export(t).join(known, F.col("position") == F.col("conv_id"), "left_semi").select("conv_hash")


@query("walk_messages", """
  SELECT conv_id, turn::INTEGER AS pos, role, text FROM turns""", ("turns",))
def walk_messages(t):
    walked = importer.walk_messages(A.chat_export(t))
    return walked.select(F.col("position").alias("conv_id"), F.inline("messages")).select("conv_id", "pos", "role", "text")


@query("conversation_gate", """
  SELECT conv_id, conv_hash, message_count, user_words::BIGINT AS user_words, date_text, skip_reason FROM decisions""",
       ("turns", "convs", "decisions"))
def conversation_gate(t):
    return _decisions(t).select(F.col("position").alias("conv_id"), "conv_hash", F.col("message_count").cast("bigint").alias("message_count"),
                                F.col("user_words").cast("bigint").alias("user_words"), "date_text", "skip_reason")


@query("conversation_gate_with_ledger_and_dates", """
  SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 'already_imported'
    WHEN date_text < '2024-01-02' THEN 'before_date_filter' WHEN date_text > '2024-01-03' THEN 'after_date_filter'
    ELSE skip_reason END AS skip_reason FROM decisions""", ("turns", "convs", "decisions"))
def conversation_gate_with_ledger_and_dates(t):
    return _decisions(t, ledger=_ledger(t), after="2024-01-02", before="2024-01-03").select(
        F.col("position").alias("conv_id"), "skip_reason")


@query("not_imported", """
  SELECT conv_id FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""", ("turns", "convs"))
def not_imported(t):
    return importer.not_imported(A.chat_export(t), _ledger(t)).select(F.col("position").alias("conv_id"))


@query("limit_processed", """
  , stop AS (SELECT conv_id AS last FROM decisions WHERE skip_reason IS NULL ORDER BY conv_id LIMIT 1 OFFSET 9)
  SELECT coalesce(skip_reason, 'processed') AS reason, count(*) AS conversations FROM decisions
  WHERE conv_id <= coalesce((SELECT last FROM stop), 9223372036854775807) GROUP BY 1""", ("turns", "convs", "decisions"))
def limit_processed(t):
    """Stop after ten processed conversations, oldest first."""
    return importer.import_counters(importer.limit_processed(_decisions(t), 10)).select("reason", "conversations")


@query("import_counters", """
  SELECT coalesce(skip_reason, 'processed') AS reason, count(*) AS conversations,
         sum(CASE WHEN skip_reason IS NULL THEN user_words ELSE 0 END)::BIGINT AS user_words
  FROM decisions GROUP BY 1""", ("turns", "convs", "decisions"))
def import_counters(t):
    return importer.import_counters(_decisions(t))


@query("import_totals_and_cost", """
  SELECT total, 0::BIGINT AS already_imported, filtered, processed, words AS user_words, processed AS thoughts, 0::BIGINT AS ingested,
         0::BIGINT AS errors, round(processed::DOUBLE * 0.00024, 9) AS summary_cost, round(processed::DOUBLE * 0.000002, 9) AS embedding_cost,
         round(processed::DOUBLE * 0.000242, 9) AS total_cost
  FROM (SELECT count(*) AS total, count(skip_reason) AS filtered, count(*) - count(skip_reason) AS processed,
               sum(CASE WHEN skip_reason IS NULL THEN user_words ELSE 0 END)::BIGINT AS words FROM decisions)""",
       ("turns", "convs", "decisions"))
def import_totals_and_cost(t):
    decided = _decisions(t)
    totals = importer.import_totals(decided, importer.extract_thoughts(decided))
    priced = importer.import_cost(totals)
    return priced.select(*totals.columns, *[F.round(c, 9).alias(c) for c in ("summary_cost", "embedding_cost", "total_cost")])


@query("import_thoughts", """
  SELECT conv_hash, 1 AS thought_no, '[ChatGPT: ' || title || ' | ' || date_text || '] ' || user_text AS content,
         conv_id::VARCHAR AS conversation_id, 'https://chatgpt.com/c/' || conv_id AS conversation_url
  FROM decisions WHERE skip_reason IS NULL""", ("turns", "convs", "decisions"))
def import_thoughts(t):
    rows = importer.extract_thoughts(_decisions(t))
    return rows.select("conv_hash", "thought_no", "content",
                       F.get_json_object("metadata", "$.conversation_id").alias("conversation_id"),
                       F.get_json_object("metadata", "$.conversation_url").alias("conversation_url"))


@query("import_report", """
  SELECT conv_hash, date_text, message_count, user_words::BIGINT AS user_words,
         CASE WHEN length(user_text) > 200 THEN user_text[1:200] || '...' ELSE user_text END AS preview
  FROM decisions WHERE skip_reason IS NULL""", ("turns", "convs", "decisions"))
def import_report(t):
    decided = _decisions(t)
    _, detail = importer.import_report(decided, importer.extract_thoughts(decided))
    return detail.select("conv_hash", "date_text", F.col("message_count").cast("bigint").alias("message_count"),
                         F.col("user_words").cast("bigint").alias("user_words"), "preview")


@query("ingest_payload", """
  SELECT conv_hash AS hash, '[ChatGPT: ' || title || ' | ' || date_text || '] ' || user_text AS content,
         'chatgpt' AS source, user_text AS full_text
  FROM decisions WHERE skip_reason IS NULL""", ("turns", "convs", "decisions"))
def ingest_payload(t):
    lines = sinks.to_ingest_payload(importer.extract_thoughts(_decisions(t)))
    get = lambda path, name: F.get_json_object("value", path).alias(name)
    return lines.select(get("$.extra_metadata.chatgpt_conversation_hash", "hash"), get("$.content", "content"),
                        get("$.source", "source"), get("$.full_text", "full_text"))


@query("ledger_after_import", """
  SELECT conv_hash, '2024-02-01 00:00:00' AS ingested_at FROM decisions WHERE skip_reason IS NULL AND NOT contains(user_text, 'qu')""",
       ("turns", "convs", "decisions"))
def ledger_after_import(t):
    """Conversations whose thoughts were all stored; here storing fails for texts with ``qu``."""
    rows = importer.extract_thoughts(_decisions(t)).withColumn("ok", ~F.col("user_text").contains("qu"))
    return sinks.ledger_rows(rows, "2024-02-01").select("conv_hash", time_text("ingested_at"))


@query("thoughts_without_embedding", """
  SELECT source, count(*) AS rejected FROM thoughts WHERE embedding IS NULL GROUP BY source""", ("thoughts",))
def thoughts_without_embedding(t):
    """What the thought sink would reject."""
    return A.thoughts(t).where(F.col("embedding").isNull()).groupBy("source").agg(F.count("*").alias("rejected"))


@query("emails_to_thoughts", """
  SELECT text AS content, source AS sender, lang AS subject FROM documents
  WHERE (TIMESTAMP '2024-01-01' + to_hours(((doc_id * 7) % 720)::INTEGER))::DATE >= DATE '2024-01-10' AND trim(text) <> ''""")
def emails_to_thoughts(t):
    """Documents as emails since 10 January."""
    mails = A.thoughts(t).select(F.col("source").alias("sender"), F.col("lang").alias("subject"), F.col("created_at").alias("sent_at"),
                                 F.array("lang").alias("labels"), F.col("content").alias("body"))
    out = imports.emails_to_thoughts(mails, after="2024-01-10")
    return out.select("content", F.get_json_object("metadata", "$.sender").alias("sender"),
                      F.get_json_object("metadata", "$.subject").alias("subject"))


@query("notes_to_thoughts", r"""
  SELECT title, regexp_replace(body, '^\s+|\s+$', '', 'g') AS content FROM (
    SELECT doc_id::VARCHAR AS title, text || chr(10) || 'filed under ' || lang || ' by ' || source AS body FROM documents)""")
def notes_to_thoughts(t):
    """Documents as notes with front matter, a link and a tag."""
    body = F.concat(F.lit("---\nkind: note\n---\n"), "text", F.lit("\nfiled under #"), "lang", F.lit(" by [["), "source", F.lit("]]"))
    notes = t.read("documents").select(F.col("doc_id").cast("string").alias("name"), body.alias("body"),
                                       F.lit("2024-01-01").cast("timestamp").alias("modified_at"))
    return imports.notes_to_thoughts(notes).select(F.get_json_object("metadata", "$.title").alias("title"), "content")


@query("rows_to_thoughts", """
  SELECT 'p_name: ' || p_name || '. p_brand: ' || p_brand || '. p_size: ' || p_size AS content FROM part""")
def rows_to_thoughts(t):
    return imports.rows_to_thoughts(t.read("part"), ["p_name", "p_brand", "p_size"]).select("content")


@query("union_sources", """
  SELECT source, count(*) AS thoughts, sum(length(content))::BIGINT AS characters FROM (
    SELECT source, content FROM thoughts UNION ALL SELECT 'slack', content FROM captures
    UNION ALL SELECT 'csv', 'p_name: ' || p_name FROM part) GROUP BY source""", ("thoughts", "captures"))
def union_sources(t):
    rows = imports.rows_to_thoughts(t.read("part"), ["p_name"]).withColumn("source", F.get_json_object("metadata", "$.source"))
    every = imports.union_sources(A.thoughts(t).drop("embedding"), A.captures(t), rows)
    return every.groupBy("source").agg(F.count("*").alias("thoughts"), F.sum(F.length("content")).alias("characters"))


@query("tag_captures", """
  SELECT id, type, array_to_string(topics, '|') AS topics, array_to_string(people, '|') AS people,
         array_to_string(action_items, '|') AS action_items, array_to_string(dates_mentioned, '|') AS dates_mentioned
  FROM captures""", ("captures",))
def tag_captures(t):
    """Template tagging of every captured message."""
    return A.captures(t).select("id", "type", *[F.array_join(c, "|").alias(c) for c in
                                                 ("topics", "people", "action_items", "dates_mentioned")])


@query("preview_documents", """
  SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents""")
def preview_documents(t):
    return t.read("documents").select("doc_id", preview("text").alias("preview"))


@query("summarise_with_hook", """
  SELECT conv_hash, thought_no FROM (
    SELECT conv_hash, unnest(range(1, 1 + least(3, greatest(message_count - 3, 0))::INTEGER)) AS thought_no
    FROM decisions WHERE skip_reason IS NULL)""", ("turns", "convs", "decisions"))
def summarise_with_hook(t):
    """A user-supplied summariser: one thought per message after the third, three at most."""
    def fn(title, date, text):
        return [f"thought {i}" for i in range(3)] + [" "]
    decided = _decisions(t).where("skip_reason is null")
    rows = hooks.summarise(decided, fn)
    wanted = F.least(F.lit(3), F.greatest(F.col("message_count") - 3, F.lit(0)))
    return rows.select("conv_hash", F.posexplode(F.slice("thoughts", F.lit(1), wanted)).alias("i", "thought")).select(
        "conv_hash", (F.col("i") + 1).cast("bigint").alias("thought_no"))


@query("thought_sink", """
  SELECT CASE WHEN embedding IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS thoughts, sum(length(content))::BIGINT AS characters
  FROM thoughts GROUP BY 1""", ("thoughts",))
def thought_sink(t):
    """Thoughts written to the sink and read back."""
    good, bad = sinks.write_thoughts(A.thoughts(t), fresh_path(t.spark, "thoughts"))
    both = good.withColumn("outcome", F.lit("accepted")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.groupBy("outcome").agg(F.count("*").alias("thoughts"), F.sum(F.length("content")).alias("characters"))


@query("run_import", """
  SELECT count(*) AS total, 0::BIGINT AS already_imported, count(skip_reason) AS filtered, count(*) - count(skip_reason) AS processed,
         count(*) - count(skip_reason) AS thoughts, count(*) - count(skip_reason) AS ingested, 0::BIGINT AS errors, 0::DOUBLE AS summary_cost
  FROM decisions""", ("turns", "convs", "decisions"))
def run_import(t):
    """A whole raw-mode import into a new folder."""
    summary = importer.run_import(A.chat_export(t), fresh_path(t.spark, "import"), "2024-02-01", dim=16)
    return summary.select("total", "already_imported", "filtered", "processed", "thoughts", "ingested", "errors", "summary_cost")


@query("run_import_twice", """
  SELECT count(*) AS total, count(*) - count(skip_reason) AS already_imported, count(skip_reason) AS filtered, 0::BIGINT AS processed,
         0::BIGINT AS ingested, count(*) - count(skip_reason) AS stored FROM decisions""", ("turns", "convs", "decisions"))
def run_import_twice(t):
    """The same export imported twice, the first time with an embedder that fails on some thoughts: a third run finds
    everything in the ledger, and every thought is stored once."""
    folder, export = fresh_path(t.spark, "import"), A.chat_export(t)
    importer.run_import(export, folder, "2024-02-01", embedder=lambda texts: [None if len(x) % 2 else [1.0] for x in texts])
    importer.run_import(export, folder, "2024-02-02", embedder=lambda texts: [[1.0] for _ in texts])
    summary = importer.run_import(export, folder, "2024-02-03", embedder=lambda texts: [[1.0] for _ in texts])
    stored = t.spark.read.parquet(f"{folder}/thoughts").where("outcome = 'accepted'").count()
    return summary.select("total", "already_imported", "filtered", "processed", "ingested", F.lit(stored).cast("long").alias("stored"))


@query("direct_captures", """
  SELECT id, type, array_to_string(list_concat(['inbox'], topics), '|') AS topics FROM captures""", ("captures",))
def direct_captures(t):
    """Captures stored directly with a tag of their own."""
    rows = A.captures(t).select(F.col("content").alias("thought"), F.array(F.lit("inbox")).alias("tags"), "created_at", "id")
    told = imports.captures_to_thoughts(rows.withColumn("created_at", F.struct("created_at", "id")))
    topics = F.from_json(F.get_json_object("metadata", "$.topics"), "array<string>")
    return told.select("created_at.id", F.get_json_object("metadata", "$.type").alias("type"), F.array_join(topics, "|").alias("topics"))


@query("planned_meals", """
  SELECT o_orderkey AS id, meal_type FROM orders, (VALUES ('lunch'), ('dinner')) v(meal_type)""")
def planned_meals(t):
    """Weekly requests of two meals each, as plan rows."""
    from keepsake.operators.meals import plan_rows
    meal = lambda kind: F.struct(F.lit("monday").alias("day_of_week"), F.lit(kind).alias("meal_type"), F.col("o_orderkey").alias("recipe_id"))
    requests = t.read("orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("week_start"),
                                       F.array(meal("lunch"), meal("dinner")).alias("meals"))
    return plan_rows(requests).select(F.col("recipe_id").alias("id"), "meal_type")


def _written_export(t, zipped=False):
    """The conversations as files of an export, one array per task that writes, and a file that is no array.

    Files are written in the shared folder, renamed when they are complete, so a task that is run again changes nothing.
    """
    folder = fresh_path(t.spark, "export")
    system, base = located(folder)
    system.create_dir(base)

    def arrays(number, batches):
        name = f"conversations-{number:03d}.json"
        system, base = located(folder)
        target = f"{base}/{name}.zip" if zipped else f"{base}/{name}"
        part = f"{target}.{uuid.uuid4().hex}.part"

        def put(out):
            out.write(b"[")
            for i, value in enumerate(v for batch in batches for v in batch.column(0).to_pylist()):
                out.write((", " if i else "").encode() + value.encode())
            out.write(b"]\n")

        with system.open_output_stream(part) as out:
            if zipped:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    with archive.open(f"inner/{name}", "w") as member:
                        put(member)
                    archive.writestr("conversations.json", "{}")
            else:
                put(out)
        system.move(part, target)

    def write(batches):
        arrays(TaskContext.get().partitionId(), batches)
        yield from ()

    one = F.struct("id", "title", F.col("create_time").cast("bigint").alias("create_time"), "is_do_not_remember",
                   F.parse_json("mapping").alias("mapping"))
    rows = A.chat_export(t).select(F.to_json(one).alias("value")).repartition(3)
    rows.mapInArrow(write, "done boolean").count()
    if not zipped:
        with system.open_output_stream(f"{base}/conversations.json") as out:
            out.write(b'{"user": "no array"}')
    return folder


_EXPORTED = """
  SELECT conv_hash, conv_id::VARCHAR AS id, message_count, user_words::BIGINT AS user_words, date_text FROM decisions"""


def _read_back(t, zipped):
    read = chat_export.read_chat_export(t.spark, _written_export(t, zipped), zipped=zipped)
    decided = importer.decision_table(read, fresh_path(t.spark, "decisions"))
    return decided.select("conv_hash", "id", F.col("message_count").cast("bigint").alias("message_count"),
                          F.col("user_words").cast("bigint").alias("user_words"), "date_text")


@query("read_export_directory", _EXPORTED, ("turns", "convs", "decisions"))
def read_export_directory(t):
    """Conversations written as an export directory and read back in byte ranges."""
    return _read_back(t, zipped=False)


@query("read_export_archives", _EXPORTED, ("turns", "convs", "decisions"))
def read_export_archives(t):
    """Conversations written as zip archives and read back member by member."""
    return _read_back(t, zipped=True)


@query("export_files", """
  SELECT 'not an array' AS state, 1::BIGINT AS files, 0::BIGINT AS conversations
  UNION ALL SELECT 'read', least(3, count(*)), count(*) FROM convs""", ("turns", "convs"))
def export_files(t):
    """What became of each file of an export directory."""
    _, files = chat_export.export_parts(t.spark, _written_export(t))
    return files.where("state <> 'read' OR elements > 0").groupBy("state").agg(
        F.count(F.lit(1)).alias("files"), F.sum("elements").alias("conversations"))


def _answer(text: str) -> str:
    """A tagger as unreliable as a model: JSON, JSON that is no object, prose, and JSON without topics."""
    if text.startswith("Meeting"):
        return json.dumps({"type": "meeting", "topics": ["people", "plans"], "source": "model"})
    return "[1, 2]" if text.startswith("Decision") else "I can't tell." if text.startswith("Insight") else '{"type": "note"}'


@query("custom_tagger", """
  SELECT id, 'mcp' AS source,
    CASE event_type WHEN 'view' THEN 'meeting' WHEN 'purchase' THEN 'observation' WHEN 'error' THEN 'observation' ELSE 'note' END AS type,
    CASE event_type WHEN 'view' THEN '["people","plans"]' WHEN 'purchase' THEN '["uncategorized"]' WHEN 'error' THEN '["uncategorized"]' END AS topics
  FROM captures""", ("captures",))
def custom_tagger(t):
    """Captures tagged by a function of one's own, whose answers are checked; the source's keys win."""
    tagged = hooks.tag(A.captures(t).select("id", "content"), _answer).withColumn(
        "metadata", merge_metadata("tags_json", {"source": F.lit("mcp")}))
    get = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return tagged.select("id", get("source"), get("type"), get("topics"))
