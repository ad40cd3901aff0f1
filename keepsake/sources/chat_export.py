"""Reader of chat exports: JSON files or zip archives of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.text import conv_hash, number_text
from keepsake.sources.json_arrays import archive_chunks, array_elements, file_chunks

# Names of the conversation files of an export.
FILE_PATTERN = r"^conversations(-\d+)?\.json$"
ENTRY_PATTERN = r"(?:^|/)conversations(?:-\d+)?\.json$"

_ITEM = ("struct<id:string,title:string,create_time:string,is_do_not_remember:boolean,"
         "mapping:string>")


def parse_export_files(texts: DataFrame) -> DataFrame:
    """Conversations of whole export files given as ``file, value``, such as a stream delivers them."""
    body = F.ltrim(F.col("value"), F.lit("\ufeff \t\r\n"))
    arrays = texts.select("file", body.alias("body")).where(F.col("body").startswith("["))
    return parse_conversations(arrays.select(
        "file", F.posexplode(F.from_json("body", "array<string>", {"mode": "FAILFAST"})).alias("position", "raw")))


def parse_conversations(raw: DataFrame) -> DataFrame:
    """Conversations given as ``file, position, raw``, the JSON text of one each."""
    item = F.from_json("raw", _ITEM, {"mode": "FAILFAST"})
    parsed = raw.select("file", "position", item.alias("c"), F.json_object_keys("raw").alias("keys"))
    # A missing key hashes as empty text, a JSON null as the word None.
    absent = lambda name, text: F.when(~F.array_contains("keys", name), F.lit(text))
    title_hashed = absent("title", "").otherwise(F.coalesce("c.title", F.lit("None")))
    time_hashed = absent("create_time", "").otherwise(
        F.coalesce(number_text("c.create_time"), F.lit("None")))
    title_shown = absent("title", "(untitled)").otherwise(F.coalesce("c.title", F.lit("None")))
    return parsed.select(
        conv_hash(title_hashed, time_hashed).alias("conv_hash"), "file", "position", "c.id", "c.title",
        title_shown.alias("title_shown"), F.col("c.create_time").cast("double").alias("create_time"),
        F.coalesce("c.is_do_not_remember", F.lit(False)).alias("is_do_not_remember"), "c.mapping")


def export_parts(spark: SparkSession, path: str, zipped: bool = False, **chunks) -> tuple[DataFrame, DataFrame]:
    """The conversations of an export as ``file, position, raw``, and what became of each file: ``file, elements, state``.

    A file whose top level is not an array is skipped with the state ``not an array``; a file of no bytes has no row.
    """
    found = (archive_chunks(spark, path, ENTRY_PATTERN, **chunks) if zipped
             else file_chunks(spark, path, "conversations*.json", FILE_PATTERN, **chunks))
    return array_elements(found, "export-chunks")


def read_chat_export(spark: SparkSession, path: str, zipped: bool = False,
                     require_rows: bool = True) -> DataFrame:
    """Conversations of an export directory, or of zip archives (``zipped=True``).

    Columns: ``conv_hash, file, position, id, title, title_shown, create_time,
    is_do_not_remember, mapping`` with ``mapping`` as the raw JSON text of the message tree.

    A file is read in byte ranges by many tasks, an archive one member to a task; no file, archive or member is ever a
    single row (``json_arrays``). Files whose top level is not an array are skipped (``export_parts`` names them), malformed
    JSON fails the job, and an export without conversations is an error (``require_rows=False`` leaves that check out).
    """
    parts, files = export_parts(spark, path, zipped)
    if require_rows and files.where("elements > 0 OR state = 'malformed'").isEmpty():
        raise ValueError(f"no conversations found in {path}")
    return parse_conversations(parts)
