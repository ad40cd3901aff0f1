"""Extension points: summariser, embedder and tagger supplied by the user.

Each takes a plain Python function that runs inside Spark tasks (for instance a client of a model
service) and ships with a default that needs no service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.text import strip, tag_text

# Input limits of the usual model services, for callers that pass ``max_chars``.
SUMMARY_INPUT_CHARS = 6000
EMBEDDING_INPUT_CHARS = 8000
PART_ROWS = 256  # rows whose texts are Python objects at a time


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of ``PART_ROWS`` at most, so that few long texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def summarise(df: DataFrame, fn: Callable[[str, str, str], Iterable[str]] | None = None,
              max_chars: int | None = None) -> DataFrame:
    """Add ``thoughts`` (array of text) from ``title_shown``, ``date_text`` and ``user_text``.

    Without ``fn`` the raw mode applies: one thought holding the whole user text. Otherwise
    ``fn(title, date, text)`` returns any number of thoughts; blank ones are dropped. None, for a model that
    failed, gives NULL. ``max_chars`` cuts the text given to ``fn`` (not the stored one).
    """
    if fn is None:
        return df.withColumn("thoughts", F.array("user_text"))
    schema = T.StructType(df.schema.fields + [T.StructField("thoughts", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            answers = [fn(title, day, text[:max_chars])
                       for title, day, text in zip(*(part[c].to_pylist() for c in ("title_shown", "date_text", "user_text")))]
            thoughts = [None if a is None else [t for t in a if isinstance(t, str) and t.strip()] for a in answers]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(thoughts, pa.list_(pa.string()))], names=[*part.schema.names, "thoughts"])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, fn: Callable[[list[str]], list] | None = None, text: str = "content",
          max_chars: int | None = None, dim: int = 64) -> DataFrame:
    """Add ``embedding`` (array<float>, NULL where the embedder fails).

    ``fn`` gets a batch of texts and returns one vector or None for each. The default hashes words
    into ``dim`` buckets and normalises: a stand-in for tests and demos, not a semantic model.
    """
    if fn is not None:
        @F.pandas_udf("array<float>")
        def vectors(s: pd.Series) -> pd.Series:
            return pd.Series(list(fn([t[:max_chars] for t in s])), index=s.index)

        return df.withColumn("embedding", vectors(F.coalesce(F.col(text), F.lit(""))))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    out = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for stage in (words, counts, unit):
        out = stage.transform(out)
    vector = F.when(F.size("_words") > 0, vector_to_array("_unit", "float32"))
    return out.withColumn("embedding", vector).drop("_text", "_words", "_counts", "_unit")


def tag(df: DataFrame, fn: Callable[[str], str] | None = None, text: str = "content") -> DataFrame:
    """Add ``tags_json``, the extracted metadata as JSON text.

    ``fn(text)`` returns JSON (whatever a model answered; it is checked when merged). The default
    reads the five capture templates.
    """
    if fn is None:
        # Stripped in a step of its own: the tagger reads the text many times.
        return (df.withColumn("_stripped", strip(text)).withColumn("tags_json", F.to_json(tag_text("_stripped")))
                .drop("_stripped"))

    @F.pandas_udf("string")
    def answers(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return df.withColumn("tags_json", answers(F.coalesce(F.col(text), F.lit(""))))
