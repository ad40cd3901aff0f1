"""Sinks of the importer: thoughts, payload lines, the ledger and the report."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.dates import moment

LEDGER_SCHEMA = "conv_hash string, ingested_at timestamp"


def promote_keys(df: DataFrame, keys: tuple[str, ...] = ("source", "type")) -> DataFrame:
    """Repeat frequent metadata keys as text columns, which Parquet statistics can filter.

    Pass them to a search as ``promoted={"source": "source"}``.
    """
    for key in keys:
        if key not in df.columns:
            df = df.withColumn(key, F.get_json_object("metadata", f"$.{key}"))
    return df


def write_thoughts(df: DataFrame, path: str, promote: tuple[str, ...] = ("source", "type")) -> tuple[DataFrame, DataFrame]:
    """Append thoughts; a row without an embedding is rejected. Returns (accepted, rejected).

    Accepted and rejected rows go to two partition folders of one write, so that embeddings (the
    expensive part of the plan) are computed once. ``promote`` names the metadata keys stored as
    columns as well.
    """
    accepted = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    outcome = F.when(accepted, "accepted").otherwise("rejected")
    if "metadata" in df.columns:
        df = promote_keys(df, promote)
    df.withColumn("outcome", outcome).write.mode("append").partitionBy("outcome").parquet(path)
    table = df.sparkSession.read.parquet(path)
    part = lambda name: table.where(F.col("outcome") == name).drop("outcome")
    return part("accepted"), part("rejected")


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """``conv_hash, thought_no`` of the accepted thoughts of a sink; none when it does not exist yet."""
    schema = "conv_hash string, thought_no int"
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table.where("outcome = 'accepted'").select("conv_hash", "thought_no")


def to_ingest_payload(df: DataFrame) -> DataFrame:
    """One JSON payload per thought for a custom ingest endpoint.

    Needs ``content, title_shown, date_text, conv_hash, metadata, user_text``.
    """
    extra = F.struct(
        F.col("title_shown").alias("chatgpt_title"),
        F.col("date_text").alias("chatgpt_create_time"),
        F.col("conv_hash").alias("chatgpt_conversation_hash"),
        F.parse_json("metadata").alias("source_ref"))
    body = F.struct("content", F.lit("chatgpt").alias("source"), extra.alias("extra_metadata"),
                    F.when(F.col("user_text") != "", F.col("user_text")).alias("full_text"))
    return df.select(F.to_json(body).alias("value"))


def write_payload_lines(df: DataFrame, path: str) -> None:
    """Write payloads as JSON lines."""
    to_ingest_payload(df).write.mode("append").text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger of imported conversations; an empty one when nothing was imported yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def ledger_rows(results: DataFrame, as_of) -> DataFrame:
    """Conversations to record: every thought stored, or nothing to store (``ok`` NULL).

    ``results`` has one row per thought, or one row with NULL ``ok`` for an empty summary.
    """
    done = results.groupBy("conv_hash").agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("done"))
    return done.where("done").select("conv_hash", moment(as_of).alias("ingested_at"))


def update_ledger(results: DataFrame, path: str, as_of) -> DataFrame:
    """Append finished conversations to the ledger and return the whole ledger.

    Do not call it on a dry run.
    """
    ledger_rows(results, as_of).write.mode("append").parquet(path)
    return read_ledger(results.sparkSession, path)


def write_report(counters: DataFrame, detail: DataFrame, folder: str) -> None:
    """Report tables: counters and the listing of thoughts per conversation, as JSON lines."""
    counters.write.mode("overwrite").json(os.path.join(folder, "counters"))
    detail.write.mode("overwrite").json(os.path.join(folder, "conversations"))
