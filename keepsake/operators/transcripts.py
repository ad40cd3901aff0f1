"""Transcript reading: the tail of long transcripts and exact quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.predicates import ilike_contains


def transcript_tail(docs: DataFrame, min_lines: int = 100, share: float = 0.3) -> DataFrame:
    """Lines for a second pass: the last ``share`` of transcripts over ``min_lines`` lines, all lines
    of shorter ones. Columns ``id, line_no`` (from 1) and ``line``.

    Works inside the row, so documents are never shuffled.
    """
    n = F.size("_lines")
    kept = F.when(n > min_lines, F.ceil(n * F.lit(share)).cast("int")).otherwise(n)
    split = docs.select("id", F.split("content", "\n").alias("_lines"))
    # The tail is cut out before the lines become rows, so the head is never produced.
    tail = split.select("id", (n - kept).alias("_skip"), F.slice("_lines", n - kept + 1, kept).alias("_tail"))
    return tail.select("id", "_skip", F.posexplode("_tail").alias("_at", "line")).select(
        "id", (F.col("_at") + F.col("_skip") + 1).alias("line_no"), "line")


def find_quotes(docs: DataFrame, keyword: str) -> DataFrame:
    """Lines that contain a keyword, with their number: ``id, line_no, line``."""
    return (docs.where(ilike_contains("content", keyword))
            .select("id", F.posexplode(F.split("content", "\n")).alias("_at", "line"))
            .where(ilike_contains("line", keyword))
            .select("id", (F.col("_at") + 1).alias("line_no"), "line"))
