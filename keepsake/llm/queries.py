"""The dealt operators as named queries over the table folder, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (decontamination, fill_in_middle, jaccard_join, line_rules, mixing, personal_data, quality_model, repeats,
                          suffix_trees, token_alignment, token_files, tool_calls, toxicity)
from keepsake.llm.common import table
from keepsake.session import fresh_path


def op1_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document in ORC files, read back."""
    path = fresh_path(spark, "token-orc")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.PATTERN)
    return token_files.token_digests(spark, path)


def op2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents stay once lines shared by many documents of their source are removed."""
    return line_rules.apply_line_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_words_left")


def op3_deep_shallow(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without byte strings of 100 that came before."""
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_weak_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = personal_data.find_personal_data(table(spark, folder, "documents"))
    counts = [personal_data.count_of("base", kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        personal_data.listed(F.col("spans")).alias("spans"))


def op5_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontamination.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words each document gives to a mix of all sources."""
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def op7_vertical_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingles agree by 85%."""
    return jaccard_join.jaccard_components(table(spark, folder, "documents")).drop("version")


def op8_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every conversation: user and assistant turns as linked tool calls and results, and turns of any other role."""
    turns = table(spark, folder, "conversations")
    return tool_calls.link_calls(*tool_calls.turns_as_calls(turns), {"ask": tool_calls.ASK}, tool_calls.other_turns(turns))


def op8_all_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The same with calls that need the next one, four to a chain, so that levels order them."""
    turns = table(spark, folder, "conversations")
    return tool_calls.link_calls(*tool_calls.turns_as_calls(turns, chain=4), {"ask": tool_calls.ASK}, tool_calls.other_turns(turns))


def op9_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels are learned outside the held-out fold."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(toxicity.in_training_fold("doc_id"))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(~toxicity.in_training_fold("doc_id"), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a scorer trained on weighted votes."""
    return quality_model.score_quality(table(spark, folder, "documents"))


def op11_prefix_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages of 20 words that came before."""
    found = suffix_trees.remove_passages(table(spark, folder, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_counted_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in fill-in-the-middle form, and the text rebuilt from that."""
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_shared_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two vocabularies over every document, aligned, with corpus-wide counts of linked ids."""
    found = token_alignment.align_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                         public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_token_orc, op2_line_frequency, op3_deep_shallow, op4_weak_pii, op5_spaced_seeds, op6_pivotal_mix, op7_vertical_jaccard, op8_tool_calls,
    op8_all_messages, op9_compression_toxicity, op10_weak_label_quality, op11_prefix_suffix_trees, op12_counted_fim, op13_shared_cuts)}
SQL: dict[str, str] = {"op2_line_frequency": line_rules.SQL, "op8_tool_calls": tool_calls.SQL,
                       "op8_all_messages": tool_calls.CHAIN_SQL, "op12_counted_fim": fill_in_middle.SQL}
