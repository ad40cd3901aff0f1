"""Answers of a summariser, kept by what was asked: one call per question, however often a job is repeated."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators.hooks import summarise

ANSWERS = "answer_key string, thoughts array<string>"


def with_retries(fn: Callable[..., Iterable[str] | None], attempts: int = 3, wait: float = 1.0) -> Callable[..., list[str] | None]:
    """``fn`` called up to ``attempts`` times, with waits of ``wait``, twice ``wait``, ... seconds in between; None when every
    call raised or gave None."""
    def asked(*args):
        for attempt in range(attempts):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                answer = fn(*args)
                if answer is not None:
                    return list(answer)
            except Exception:  # whatever a client raises counts as no answer
                continue
        return None

    return asked


def answer_key(version: str, max_chars: int | None = None) -> Column:
    """A hash of all that the summariser is given, and of the ``version`` of its prompt and model."""
    text = F.col("user_text") if max_chars is None else F.left(F.col("user_text"), F.lit(max_chars))
    parts = [F.lit(version), F.col("title_shown"), F.col("date_text"), text]
    return F.sha2(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])).cast("binary"), 256)


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """``answer_key, thoughts``: one answer for each question. Should two jobs have asked the same at the same time, the least counts."""
    try:
        rows = spark.read.schema(f"{ANSWERS}, call string").parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)
    return rows.groupBy("answer_key").agg(F.min("thoughts").alias("thoughts"))


def summarise_kept(df: DataFrame, fn: Callable[[str, str, str], Iterable[str] | None], store: str, version: str = "1",
                   max_chars: int | None = None, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``summarise`` that asks only what ``store`` has no answer for, each different question once.

    New answers are written to a folder of their own below ``store`` before anything reads them, so a later failure, a repeated batch
    or another run meets the same ones. A call that fails is repeated ``attempts`` times; if it still fails, nothing is kept
    and ``thoughts`` is null. An empty answer is an answer.
    """
    spark = df.sparkSession
    keyed = df.withColumn("answer_key", answer_key(version, max_chars))
    asked = keyed.select("answer_key", "title_shown", "date_text", "user_text").dropDuplicates(["answer_key"])
    new = summarise(asked.join(kept_answers(spark, store).select("answer_key"), "answer_key", "left_anti"),
                    with_retries(fn, attempts, wait), max_chars)
    new.where("thoughts is not null").select("answer_key", "thoughts").write.parquet(os.path.join(store, f"call={uuid.uuid4().hex}"))
    return keyed.join(kept_answers(spark, store), "answer_key", "left").drop("answer_key")
