"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import decontamination, jaccard_join, mixing, token_files, toxicity
from keepsake.llm.common import table, written
from keepsake.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic, from 0.3 as in ``op9``, go. Labels are learned outside the held-out fold. Null and empty texts stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").where(toxicity.in_training_fold("doc_id")), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles agree by 80% or more stays."""
    return jaccard_join.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items go."""
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their weights."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written as ORC files and read back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = fresh_path(spark, "pipeline-tokens")
    # Workers still hold memory of the stages before, so fewer pre-tokens are remembered than by default.
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, known=250_000)
    return token_files.token_digests(spark, path)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix), ("token_files", tokenize)]

#: A trained classifier, connected components, random rounding and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table gives no rows; rows alike in doc_id and text end as one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
