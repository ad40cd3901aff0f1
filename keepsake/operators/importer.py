"""Chat import: message walk, conversation gate, limit, thoughts, counters and cost.

A conversation arrives as one row with its message tree as JSON. Walking it keeps its messages in
that row (one array per conversation), so user text, message count and word count are row-local and
the import of any number of exports needs no shuffle for them. Only the ledger lookup and the
search for repeated conversations shuffle, and both move hashes, not texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keepsake.functions.dates import epoch_date
from keepsake.functions.text import (MESSAGE_SEPARATOR, chat_metadata, preview, thought_content,
                                     trivial_title, word_count)
from keepsake.operators.answers import summarise_kept
from keepsake.operators.hooks import embed, small_batches, summarise
from keepsake.session import fresh_path, reliable_checkpoint
from keepsake.sources.sinks import read_ledger, stored_keys, update_ledger, write_thoughts

# Thresholds of the gate, and unit costs in dollars per million tokens.
MIN_MESSAGES = 4
MIN_USER_WORDS = 20
TOKENS_IN, TOKENS_OUT, TOKENS_EMBEDDED = 800, 200, 100
PRICE_IN, PRICE_OUT, PRICE_EMBEDDING = 0.15, 0.60, 0.02

MESSAGE = "struct<pos:int,role:string,content_type:string,text:string>"


def _messages_in_order(mapping_text: str | None) -> list[dict]:
    """Depth-first, pre-order listing of a message tree, without recursion."""
    nodes = json.loads(mapping_text) if mapping_text else None
    if not nodes:
        return []
    seen: set[str] = set()
    out: list[dict] = []
    stack = [key for key, node in nodes.items() if node.get("parent") not in nodes]
    stack.reverse()
    while stack:
        key = stack.pop()
        if key in seen or key not in nodes:
            continue
        seen.add(key)
        message = nodes[key].get("message") or {}
        content = message.get("content")
        if content:
            parts = [p for p in content.get("parts") or [] if isinstance(p, str)]
            out.append({"pos": len(out), "role": (message.get("author") or {}).get("role"),
                        "content_type": content.get("content_type"),
                        "text": "\n".join(parts).strip()})
        stack.extend(reversed(nodes[key].get("children") or []))
    return out


def walk_messages(conversations: DataFrame) -> DataFrame:
    """Replace ``mapping`` by ``messages``: the tree's messages in conversation order.

    Roots are nodes without a known parent; every branch is visited once, children in order; nodes
    without content are left out.
    """
    keep = [f for f in conversations.schema.fields if f.name != "mapping"]
    messages = T._parse_datatype_string(f"array<{MESSAGE}>")
    schema = T.StructType(keep + [T.StructField("messages", messages)])

    names, arrow = [f.name for f in keep], to_arrow_schema(T.StructType([T.StructField("messages", messages)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            walked = pa.array([_messages_in_order(m) for m in part["mapping"].to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(part[n] for n in names), walked], names=[*names, "messages"])

    return conversations.mapInArrow(run, schema)


def with_user_text(walked: DataFrame) -> DataFrame:
    """Add ``user_text``, ``message_count`` and ``user_words``, all row-local.

    ``user_text`` joins the non-blank text messages of the user; the separator counts as a word.
    """
    texts = F.filter("messages", lambda m: (m["content_type"] == "text") & (m["text"] != ""))
    mine = F.transform(F.filter(texts, lambda m: m["role"] == "user"), lambda m: m["text"])
    return (walked.withColumn("message_count", F.size(texts))
            .withColumn("user_text", F.array_join(mine, MESSAGE_SEPARATOR))
            .withColumn("user_words", word_count("user_text"))
            .withColumn("date_text", epoch_date("create_time"))
            .drop("messages"))


def not_imported(conversations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Conversations the ledger does not list."""
    return conversations.join(ledger.select("conv_hash"), "conv_hash", "left_anti")


def gate_conversations(df: DataFrame, ledger: DataFrame | None = None, after: str | None = None,
                       before: str | None = None, repeats: bool = True) -> DataFrame:
    """Add ``skip_reason``: NULL when a conversation is to be processed, else the first reason.

    Order of reasons: already_imported, before_date_filter, after_date_filter, do_not_remember,
    too_few_messages, skip_title, too_little_text. Date bounds are inclusive and do not apply to
    conversations without a time. With ``repeats`` a conversation that comes again in the same
    import (equal hash, both acceptable) counts as already imported after its first appearance.
    """
    reason = F.lit(None).cast("string")
    dated = F.col("date_text") != "unknown"
    checks = []
    if ledger is not None:
        known = ledger.select("conv_hash").distinct().withColumn("_known", F.lit(True))
        df = df.join(known, "conv_hash", "left")
        checks.append((F.col("_known"), "already_imported"))
    if after is not None:
        checks.append((dated & (F.col("date_text") < F.lit(after)), "before_date_filter"))
    if before is not None:
        checks.append((dated & (F.col("date_text") > F.lit(before)), "after_date_filter"))
    checks += [
        (F.coalesce("is_do_not_remember", F.lit(False)), "do_not_remember"),
        (F.col("message_count") < MIN_MESSAGES, "too_few_messages"),
        (trivial_title("title"), "skip_title"),
        (F.col("user_words") < MIN_USER_WORDS, "too_little_text"),
    ]
    for test, name in reversed(checks):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    gated = df.withColumn("skip_reason", reason).drop("_known")
    return mark_repeats(gated) if repeats else gated


def mark_repeats(gated: DataFrame) -> DataFrame:
    """Let only the first of several acceptable conversations with one hash pass.

    Only hashes and positions are grouped; the join back carries the repeated hashes, a small table
    unless most of the import is repeated. ``gated`` is read twice, so a large import should hand in a
    written table (``run_import`` does).
    """
    place = F.struct("file", "position")
    first = (gated.where("skip_reason is null").groupBy("conv_hash")
             .agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    gated = gated.join(first.drop("_n"), "conv_hash", "left")
    again = F.col("skip_reason").isNull() & F.col("_first").isNotNull() & (place != F.col("_first"))
    return gated.withColumn(
        "skip_reason", F.when(again, F.lit("already_imported")).otherwise(F.col("skip_reason"))
    ).drop("_first")


def decision_table(conversations: DataFrame, path: str, ledger: DataFrame | None = None,
                   after: str | None = None, before: str | None = None) -> DataFrame:
    """Decisions on all conversations, written to ``path`` so that every later step reads the result of
    one walk over the message trees."""
    gated = gate_conversations(with_user_text(walk_messages(conversations)), ledger, after, before, repeats=False)
    gated.write.mode("overwrite").parquet(path)
    return mark_repeats(conversations.sparkSession.read.parquet(path))


def _place_order() -> list:
    return [F.col("create_time").asc_nulls_first(), F.col("conv_hash").asc(), F.col("file").asc(),
            F.col("position").asc()]


def limit_processed(decisions: DataFrame, n: int) -> DataFrame:
    """Stop after the first ``n`` processed conversations, oldest first (0 keeps all).

    Rows after the stop are not visited and so not counted, whatever their reason.
    """
    if n <= 0:
        return decisions
    keys = ["create_time", "conv_hash", "file", "position"]
    wanted = decisions.where("skip_reason is null").select(*keys)
    row = _nth(wanted, n).first()  # one row
    if row is None:
        return decisions
    before = F.lit(True)
    for key in reversed(keys):
        bound = F.lit(row[key])
        smaller = F.coalesce(F.col(key) < bound, F.col(key).isNull() & bound.isNotNull())
        before = smaller | (F.col(key).eqNullSafe(bound) & before)
    return decisions.where(before)


def _nth(rows: DataFrame, n: int) -> DataFrame:
    """The ``n``-th row in import order: a distributed sort, then partition counts."""
    placed = reliable_checkpoint(
        rows.orderBy(*_place_order())
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    done = 0
    for row in placed.groupBy("_part").count().orderBy("_part").collect():  # one row per partition
        if done + row["count"] >= n:
            return placed.where((F.col("_part") == row["_part"]) & (F.col("_at") == n - 1 - done)) \
                         .drop("_part", "_at")
        done += row["count"]
    return placed.limit(0).drop("_part", "_at")


def extract_thoughts(decisions: DataFrame, fn=None, max_chars: int | None = None, store: str | None = None,
                     version: str = "1") -> DataFrame:
    """Thoughts of the processed conversations, one row each, ready for embedding.

    With ``store`` the answers of ``fn`` are kept there under ``version`` and asked for once. Conversations without an answer, because
    the model failed, are left out: they are not done.

    ``thought_no`` counts from 1; a conversation whose summary is empty yields one row with NULL
    ``content`` so that the ledger can record it (drop it before the sink).
    """
    wanted = decisions.where("skip_reason is null")
    if fn is None or store is None:
        summed = summarise(wanted, fn, max_chars)
    else:
        summed = summarise_kept(wanted, fn, store, version, max_chars)
    summed = summed.where("thoughts is not null")
    each = summed.select(
        "conv_hash", "id", "title_shown", "date_text", "message_count", "user_words", "user_text",
        F.posexplode_outer("thoughts").alias("_i", "thought"))
    return each.select(
        "*", (F.col("_i") + 1).alias("thought_no"),
        thought_content("title_shown", "date_text", "thought").alias("content"),
        chat_metadata("id", "title_shown", "date_text").alias("metadata")).drop("_i")


def embed_new(thoughts: DataFrame, stored: DataFrame, embedder=None, max_chars: int | None = None, dim: int = 64) -> DataFrame:
    """Add ``embedding``, ``ok`` and ``fresh`` to thoughts of which some may be stored already (``conv_hash,
    thought_no``): those of a conversation that failed in part before. They pass through without another call.

    ``thoughts`` must be a written table: it is read twice, and the summariser must not run twice. Only stored keys
    of these conversations are looked at.
    """
    key = ["conv_hash", "thought_no"]
    stored = stored.join(thoughts.select("conv_hash").distinct(), "conv_hash", "left_semi").select(*key).distinct()
    embedded = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    new = embed(thoughts.join(stored, key, "left_anti"), embedder, max_chars=max_chars, dim=dim).withColumn(
        "ok", F.when(F.col("content").isNotNull(), embedded)).withColumn("fresh", F.lit(True))
    known = thoughts.join(stored, key, "left_semi").withColumn("ok", F.lit(True)).withColumn("fresh", F.lit(False))
    return new.unionByName(known, allowMissingColumns=True)


def import_counters(decisions: DataFrame) -> DataFrame:
    """Counts by outcome: ``reason`` is a skip reason, or ``processed``."""
    return (decisions.groupBy(F.coalesce("skip_reason", F.lit("processed")).alias("reason"))
            .agg(F.count("*").alias("conversations"),
                 F.sum(F.when(F.col("skip_reason").isNull(), F.col("user_words")).otherwise(0))
                 .alias("user_words")))


def import_totals(decisions: DataFrame, thoughts: DataFrame) -> DataFrame:
    """The one-row summary of an import: totals, thoughts, ingested and errors.

    ``thoughts`` may carry ``ok`` (stored or not); without it nothing was ingested (dry run).
    """
    skipped = F.col("skip_reason")
    stored = F.col("ok") if "ok" in thoughts.columns else F.lit(None).cast("boolean")
    marks = {
        "total": F.lit(True),
        "already_imported": skipped == "already_imported",
        "filtered": skipped.isNotNull() & (skipped != "already_imported"),
        "processed": skipped.isNull(),
    }
    one = lambda test: F.when(test, F.lit(1).cast("bigint"))
    visits = decisions.select(
        *[one(test).alias(name) for name, test in marks.items()],
        F.when(skipped.isNull(), F.col("user_words")).cast("bigint").alias("user_words"))
    made = thoughts.where(F.col("content").isNotNull()).select(
        one(F.lit(True)).alias("thoughts"), one(stored).alias("ingested"), one(~stored).alias("errors"))
    rows = visits.unionByName(made, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def import_cost(totals: DataFrame, raw: bool = False) -> DataFrame:
    """Add the estimated cost in dollars; raw imports pay for embeddings only."""
    million = 1_000_000
    per_conversation = 0.0 if raw else TOKENS_IN * PRICE_IN / million + TOKENS_OUT * PRICE_OUT / million
    return (totals
            .withColumn("summary_cost", F.col("processed") * F.lit(per_conversation))
            .withColumn("embedding_cost", F.col("thoughts") * F.lit(TOKENS_EMBEDDED * PRICE_EMBEDDING / million))
            .withColumn("total_cost", F.col("summary_cost") + F.col("embedding_cost")))


def import_report(decisions: DataFrame, thoughts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, detail): counters by reason, and every thought with its conversation's figures."""
    detail = thoughts.where(F.col("content").isNotNull()).select(
        "conv_hash", "title_shown", "date_text", "message_count", "user_words", "thought_no",
        "thought", preview("thought").alias("preview"))
    return import_counters(decisions), detail


def run_import(conversations: DataFrame, folder: str, as_of, after: str | None = None, before: str | None = None,
               limit: int = 0, fn=None, embedder=None, dry_run: bool = False, max_chars: int | None = None,
               dim: int = 64, embed_chars: int | None = None, version: str = "1") -> DataFrame:
    """A whole batch import into ``folder``; returns the one-row summary with its cost.

    Message trees are walked once, into a written decision table; counters, thoughts and ledger all
    read that table. Writes ``decisions``, ``thoughts`` (split by outcome), ``ledger`` and the summariser's ``answers`` below
    ``folder``; a dry run writes decisions and answers only. An answer is asked for once per conversation text and ``version``, also
    over later runs. ``max_chars`` limits what the summariser sees, ``embed_chars`` what the embedder sees.
    """
    spark = conversations.sparkSession
    below = lambda name: os.path.join(folder, name)
    ledger = read_ledger(spark, below("ledger"))
    decisions = limit_processed(decision_table(conversations, below("decisions"), ledger, after, before), limit)
    thoughts = extract_thoughts(decisions, fn, max_chars, below("answers"), version)
    if dry_run:
        return import_cost(import_totals(decisions, thoughts), raw=fn is None)
    summed, run = fresh_path(spark, "import-thoughts"), fresh_path(spark, "import-run")
    thoughts.write.parquet(summed)
    embed_new(spark.read.schema(thoughts.schema).parquet(summed), stored_keys(spark, below("thoughts")), embedder,
              embed_chars, dim).write.parquet(run)
    results = spark.read.parquet(run)
    totals = import_cost(import_totals(decisions, results), raw=fn is None)
    summary = spark.createDataFrame([totals.first()], totals.schema)  # one row
    write_thoughts(results.where("fresh and content is not null").drop("ok", "fresh", "user_text"), below("thoughts"))
    update_ledger(results, below("ledger"), as_of)
    return summary
