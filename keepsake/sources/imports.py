"""Other batch sources turned into thoughts: emails, notes, table rows.

All of them yield ``content, metadata, created_at``; ``metadata`` is JSON text and names its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.dates import day
from keepsake.functions.text import clean_note, is_blank, row_sentence, strip, tag_text

THOUGHT_COLUMNS = ("content", "metadata", "created_at")


def emails_to_thoughts(emails: DataFrame, after=None) -> DataFrame:
    """One thought per email: the body as content; sender, subject, date and labels as metadata.

    ``emails``: ``sender, subject, sent_at, labels, body``. ``after`` keeps mails of that day and
    later; blank bodies are left out.
    """
    if after is not None:
        emails = emails.where(F.to_date("sent_at") >= day(after))
    meta = F.struct(F.lit("gmail").alias("source"), "sender", "subject",
                    F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "labels")
    return emails.where(~is_blank("body")).select(
        F.col("body").alias("content"), F.to_json(meta).alias("metadata"),
        F.col("sent_at").alias("created_at"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as ``name, body, modified_at``, one row per file."""
    return (spark.read.option("pathGlobFilter", "*.md")
            .option("recursiveFileLookup", "true").text(path, wholetext=True)
            .select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("name"),
                    F.col("value").alias("body"),
                    F.col("_metadata.file_modification_time").alias("modified_at")))


def notes_to_thoughts(notes: DataFrame) -> DataFrame:
    """One thought per cleaned note; notes with nothing but structure are skipped."""
    # A one-row generator holds the cleaned note, so that it is computed once and not per use.
    cleaned = notes.select("name", "modified_at", F.inline(F.array(clean_note("body"))))
    substance = F.regexp_replace("text", r"(?m)^[ \t]*(#{1,6} .*|[-*_]{3,}|[-*+])[ \t]*$", "")
    meta = F.struct(F.lit("obsidian").alias("source"), F.col("name").alias("title"),
                    F.col("tags").alias("topics"))
    return cleaned.where(~is_blank(substance)).select(
        F.col("text").alias("content"), F.to_json(meta).alias("metadata"),
        F.col("modified_at").alias("created_at"))


def rows_to_thoughts(rows: DataFrame, cols: list[str], source: str = "csv",
                     created_at: Column | None = None) -> DataFrame:
    """One thought per table row, its fields combined into a readable line."""
    out = rows.select(
        row_sentence(cols).alias("content"),
        F.to_json(F.struct(F.lit(source).alias("source"))).alias("metadata"),
        (created_at if created_at is not None else F.lit(None).cast("timestamp")).alias("created_at"))
    return out.where(F.col("content") != "")


def captures_to_thoughts(captures: DataFrame, source: str = "mcp") -> DataFrame:
    """Thoughts of direct captures ``thought, tags, created_at``: tagged from their text, the given tags
    among the topics. Blank thoughts are left out; embed the result before storing it."""
    text = strip("thought")
    told = captures.where(~is_blank("thought")).select(text.alias("content"), "tags", "created_at")
    found = told.select("content", "created_at", "tags", tag_text("content").alias("t"))
    given = F.coalesce("tags", F.array().cast("array<string>"))
    own = F.filter("t.topics", lambda x: (x != "uncategorized") | (F.size(given) == 0))
    meta = F.struct(F.col("t.people").alias("people"), F.col("t.action_items").alias("action_items"),
                    F.col("t.dates_mentioned").alias("dates_mentioned"),
                    F.array_distinct(F.concat(given, own)).alias("topics"), F.col("t.type").alias("type"),
                    F.lit(source).alias("source"))
    return found.select("content", F.to_json(meta).alias("metadata"), "created_at")


def union_sources(*thoughts: DataFrame) -> DataFrame:
    """One thoughts table from several sources; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), thoughts)
