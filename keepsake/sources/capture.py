"""Message events of chat channels, as streams or as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.text import is_blank

SLACK_PAYLOAD = ("type string, challenge string, event struct<type:string,subtype:string,"
                 "bot_id:string,channel:string,text:string,ts:string>")
DISCORD_MESSAGE = ("message_id string, server string, channel string, author string, content string, "
                   "timestamp timestamp, edited_at timestamp")


def read_capture_stream(spark: SparkSession, source: str, schema: str = SLACK_PAYLOAD,
                        kafka: dict[str, str] | None = None) -> DataFrame:
    """Raw payloads as a stream: JSON files below ``source``, or Kafka topic ``source`` with the
    connection options in ``kafka`` (needs the connector on the class path)."""
    if kafka is None:
        return spark.readStream.schema(schema).json(source)
    raw = spark.readStream.format("kafka").options(**kafka).option("subscribe", source).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def parse_payloads(lines: DataFrame, schema: str = SLACK_PAYLOAD) -> DataFrame:
    """Lines ``file, value`` parsed without losing any: the fields of ``schema``, ``file``, ``state``, ``rescued`` and ``line``.

    ``state`` is ``parsed``, ``blank`` or ``malformed`` (no JSON object, cut off, or a value that its type can't hold); only such
    lines keep their text in ``line``. ``rescued`` names the keys at the top that the schema does not know.
    """
    names = T._parse_datatype_string(schema).fieldNames()
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    told = lines.select("file", "value", parsed.alias("p"), F.json_object_keys("value").alias("keys"))
    state = (F.when(is_blank("value"), "blank")
             .when(F.col("keys").isNull() | F.col("p").isNull() | F.col("p._broken").isNotNull(), "malformed").otherwise("parsed"))
    out = told.withColumn("state", state)
    good = F.col("state") == "parsed"
    return out.select(
        *[F.when(good, F.col("p")[n]).alias(n) for n in names], "file", "state",
        F.when(good, F.array_except("keys", F.array(*map(F.lit, names)))).alias("rescued"), F.when(~good, F.col("value")).alias("line"))


def payload_lines(spark: SparkSession, source: str) -> DataFrame:
    """The lines of payload files below ``source`` as a stream ``file, value``."""
    return spark.readStream.text(source).select(F.col("_metadata.file_path").alias("file"), "value")


def slack_events(payloads: DataFrame) -> DataFrame:
    """``type, subtype, bot_id, channel, text, ts, event_time`` of channel messages."""
    return payloads.where(F.col("event").isNotNull()).select(
        "event.*", F.timestamp_micros((F.col("event.ts").cast("decimal(20,6)") * 1_000_000).cast("bigint"))
        .alias("event_time"))


def discord_events(messages: DataFrame) -> DataFrame:
    """Messages of a Discord server in the same shape, plus the fields its metadata keeps.

    ``ts`` names a version of a message, so that an edit is not taken for a redelivery.
    """
    nothing = F.lit(None).cast("string")
    version = F.unix_micros(F.coalesce("edited_at", "timestamp")).cast("string")
    return messages.select(
        F.lit("message").alias("type"), nothing.alias("subtype"), nothing.alias("bot_id"), "channel",
        F.col("content").alias("text"), F.concat_ws(":", "message_id", version).alias("ts"),
        F.col("timestamp").alias("event_time"), "server", "author", "message_id", "edited_at")


def accept_events(events: DataFrame, channels: str | list[str]) -> DataFrame:
    """Plain user messages of the captured channels: no subtype, no bot, some text."""
    wanted = [channels] if isinstance(channels, str) else list(channels)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return events.where((F.col("type") == "message") & empty("subtype") & empty("bot_id")
                        & F.col("channel").isin(*wanted) & ~is_blank("text"))
