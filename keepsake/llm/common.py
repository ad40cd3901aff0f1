"""What the operators of this subpackage share: words, work tables, row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import fresh_path

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII space characters."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later plans start from files that outlive executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows.written_to = path
    return rows


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of ``written`` tables that no later plan reads."""
    for rows in tables:
        if rows is not None and (name := getattr(rows, "written_to", None)):
            path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Join condition on keys that may be null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
