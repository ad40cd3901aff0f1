"""Continuous capture: gate, retries, tagging, sinks, edits, digests, incremental import.

Every function works on a streaming DataFrame; all but the starters work on a plain one as well, which
is how they are checked against batch results.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.functions.text import TAG_KEYS, merge_metadata, strip, tag_text
from keepsake.operators.hooks import embed, tag
from keepsake.operators.importer import decision_table, embed_new, extract_thoughts
from keepsake.operators.state import latest_edit
from keepsake.sources.capture import SLACK_PAYLOAD, parse_payloads
from keepsake.sources.chat_export import parse_export_files
from keepsake.sources.sinks import LEDGER_SCHEMA, ledger_rows


def start_intake(lines: DataFrame, table: str, checkpoint: str, schema: str = SLACK_PAYLOAD, available_now: bool = True) -> StreamingQuery:
    """Append payload lines to ``table``, parsed and laid by ``state``, every line exactly once.

    Nothing that arrives is lost: lines that can't be parsed stand beside the others, with their text and file, and a stream of
    the parsed ones (``parsed_payloads``) goes on to the capture.
    """
    writer = (parse_payloads(lines, schema).writeStream.format("parquet").partitionBy("state").outputMode("append")
              .option("path", table).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parsed_payloads(spark: SparkSession, table: str, schema: str = SLACK_PAYLOAD) -> DataFrame:
    """The parsed payloads of an intake table as a stream; other states are not read."""
    return spark.readStream.schema(f"{schema}, state string").parquet(table).where("state = 'parsed'").drop("state")


def dedup_retries(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop redeliveries of a message (same channel and timestamp) within ``delay``.

    The sender repeats a message a few seconds after a slow answer, so a delay of minutes catches
    retries while the state holds minutes of keys, not the history.
    """
    if not events.isStreaming:
        return events.dropDuplicates(["channel", "ts"])
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["channel", "ts"])


def captured_thoughts(events: DataFrame, source: dict | None = None, tagger=None, embedder=None,
                      dim: int = 64) -> DataFrame:
    """One thought per accepted event: ``content, embedding, metadata, created_at``.

    ``source`` gives the keys the source lays over the extracted metadata (values are columns or column
    names); the default tags Slack messages.
    """
    source = source or {"source": F.lit("slack"), "slack_ts": "ts"}
    if tagger is None:
        # The default tagger gives typed fields, so its keys need no trip through JSON to be merged.
        tagged = events.withColumn("_stripped", strip("text")).withColumn("_tags", tag_text("_stripped"))
        own = [F.col(f"_tags.{k}").alias(k) for k in TAG_KEYS if k not in source]
        laid = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in source.items()]
        metadata = F.to_json(F.struct(*own, *laid))
    else:
        tagged = tag(events, tagger, "text")
        metadata = merge_metadata("tags_json", source)
    done = embed(tagged.withColumn("content", F.col("text")), embedder, dim=dim)
    return done.select("content", "embedding", metadata.alias("metadata"),
                       F.col("event_time").alias("created_at"))


def discord_source() -> dict:
    """Metadata keys of Discord captures."""
    return {"source": F.lit("discord"), "server": "server", "channel": "channel", "author": "author",
            "timestamp": F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")}


def start_capture(events: DataFrame, sink: str, checkpoint: str, dedup: bool = True,
                  delay: str = "10 minutes", available_now: bool = True, **hooks) -> StreamingQuery:
    """Append captures to Parquet, exactly once per accepted event.

    ``events`` are accepted events. ``dedup=False`` stores redeliveries as further rows.
    """
    stream = dedup_retries(events, delay) if dedup else events
    writer = (captured_thoughts(stream, **hooks).writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batch_folder(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Where a batch of the query behind ``checkpoint`` stores its rows. Batch numbers start again with a new
    checkpoint, so the folder also carries the query's id, which the checkpoint keeps."""
    row = spark.read.schema("id string").json(os.path.join(checkpoint, "metadata")).first()
    return os.path.join(f"query={row['id']}", f"batch={batch_id}")


def apply_edits(messages: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep message versions up to date: each batch stores its newest version per message.

    A batch overwrites its own folder, so a repeated batch changes nothing, and nothing that another batch or
    another checkpoint wrote is touched; ``read_edited`` gives the newest version over all batches.
    """
    spark = messages.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_edit(batch).write.mode("overwrite").parquet(os.path.join(table, _batch_folder(spark, checkpoint, batch_id)))

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_edited(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of every message."""
    return latest_edit(spark.read.parquet(table).drop("query", "batch"))


def compact_edits(spark: SparkSession, table: str) -> int:
    """Replace the finished batches of ``apply_edits`` by one folder with the newest version of each message; how many were replaced.

    The new folder is complete before the first batch goes, and a version that is there twice changes no result, so a
    run that dies at any point loses nothing and the next one ends its work. Batches without a success marker are
    still being written and stay. One compaction at a time; a reader that began before it must read again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [marker.getPath().getParent() for marker in files.globStatus(path(f"{table}/query=*/batch=*/_SUCCESS")) or []]
    if len(done) < 2:
        return 0
    rows = spark.read.option("basePath", table).parquet(*[folder.toString() for folder in done]).drop("query", "batch")
    latest_edit(rows).write.parquet(os.path.join(table, f"query=compacted-{uuid.uuid4().hex}", "batch=0"))
    for folder in done:
        files.delete(folder, True)
    return len(done)


def windowed_digest(thoughts: DataFrame, period: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Captures per topic and tumbling window: ``window_start, topic, captures``.

    Use ``'7 days'`` for the weekly form. On a stream a window is final, and is emitted, once the
    watermark has passed its end.
    """
    rows = thoughts.withWatermark("created_at", lateness) if thoughts.isStreaming else thoughts
    return (rows.select("created_at", F.explode(F.array_distinct("topics")).alias("topic"))
            .groupBy(F.window("created_at", period), "topic").agg(F.count("*").alias("captures"))
            .select(F.col("window.start").alias("window_start"), "topic", "captures"))


def run_to_end(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Write all that a stream has now to Parquet, wait, and read the sink back."""
    query = (df.writeStream.format("parquet").outputMode(mode).option("path", sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(sink)


def export_texts(spark: SparkSession, exports: str) -> DataFrame:
    """Export files below a folder as a stream of whole texts, each file once."""
    return (spark.readStream.format("text").option("wholetext", "true")
            .option("pathGlobFilter", "conversations*.json").load(exports)
            .select(F.col("_metadata.file_path").alias("file"), "value"))


def import_incremental(texts: DataFrame, out: str, checkpoint: str, as_of, summariser=None,
                       embedder=None, dim: int = 64, version: str = "1") -> StreamingQuery:
    """Import new exports as they appear; a restart goes on where the last run stopped.

    ``texts`` is a stream of ``file, value`` such as ``export_texts``. Per batch: parse, gate against
    the ledger, summarise, embed, store thoughts, then record finished conversations. Every batch
    writes its own folders below ``out`` (decisions, summaries, thoughts, ledger), so repeating a batch after a
    failure stores nothing twice. The summariser's answers are kept below ``out`` and asked for once, so a conversation that comes
    again after a partial failure meets the same ones. Thoughts that
    an earlier batch, also of another checkpoint, has stored are not embedded or stored again.
    """
    spark = texts.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        own = _batch_folder(spark, checkpoint, batch_id)
        here = lambda kind: os.path.join(out, kind, own)
        earlier = _earlier(spark, os.path.join(out, "ledger"), LEDGER_SCHEMA, own)
        decided = decision_table(parse_export_files(batch), here("decisions"), earlier)
        thoughts = extract_thoughts(decided, summariser, store=os.path.join(out, "answers"), version=version)
        thoughts.write.mode("overwrite").parquet(here("summaries"))
        stored = _earlier(spark, os.path.join(out, "thoughts"), "conv_hash string, thought_no int, ok boolean", own)
        rows = embed_new(spark.read.schema(thoughts.schema).parquet(here("summaries")),
                         stored.where("ok").select("conv_hash", "thought_no"), embedder, dim=dim)
        rows.withColumn("ok", F.coalesce("ok", F.lit(True))).write.mode("overwrite").parquet(here("thoughts"))
        ledger_rows(spark.read.parquet(here("thoughts")), as_of).write.mode("overwrite").parquet(here("ledger"))

    return (texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _earlier(spark: SparkSession, path: str, schema: str, own: str) -> DataFrame:
    """Rows of all batches but ``own`` (a repeated batch must not see what it wrote before)."""
    query, batch = (part.split("=")[1] for part in own.split(os.sep))
    try:
        rows = spark.read.schema(f"{schema}, query string, batch long").option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where((F.col("query") != query) | (F.col("batch") != int(batch))).drop("query", "batch")


def imported_thoughts(spark: SparkSession, out: str) -> DataFrame:
    """Stored thoughts of an incremental import."""
    return spark.read.parquet(os.path.join(out, "thoughts")).where("ok and fresh and content is not null").drop(
        "query", "batch", "ok", "fresh")
