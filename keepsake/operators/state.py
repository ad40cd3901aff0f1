"""Current state from logs, upserts, patches and referential actions.

"Latest row per key" is always an aggregate with a map-side combine (``max_by``), never a window
over the key: a key holding a third of all rows then costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.functions.dates import moment, plus_days


def latest_per(df: DataFrame, keys: list[str], order: list[str], take: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple."""
    take = take or [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*take), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def task_state(tasks: DataFrame, logs: DataFrame) -> DataFrame:
    """Tasks rolled forward by their last inserted log.

    ``last_completed`` is that log's ``completed_at``; ``next_due`` adds the task's frequency, NULL
    for one-time tasks. Insertion order is ``ingest_seq`` (unique, rising) where the log has one; else
    the latest ``completed_at`` counts as last, which differs for back-dated logs only. Tasks without
    a log keep their state. Both aggregates run as hash aggregates on fixed-width buffers.
    """
    newest = F.max_by("completed_at", "ingest_seq") if "ingest_seq" in logs.columns else F.max("completed_at")
    last = logs.groupBy(F.col("task_id").alias("id")).agg(newest.alias("_done"))
    done = F.col("_done")
    joined = tasks.join(last, "id", "left")
    due = plus_days("_done", F.col("frequency_days"))
    return (joined
            .withColumn("next_due", F.when(done.isNotNull(), due).otherwise(F.col("next_due")))
            .withColumn("last_completed", F.coalesce(done, "last_completed"))
            .select(*tasks.columns))


def last_contacted(contacts: DataFrame, interactions: DataFrame,
                   order: list[str] | None = None) -> DataFrame:
    """Contacts with ``last_contacted`` set by their last inserted interaction (it may move back)."""
    last = interactions.groupBy(F.col("contact_id").alias("id")).agg(
        F.max_by("occurred_at", F.struct(*(order or ["created_at", "id"]))).alias("_at"))
    return (contacts.join(last, "id", "left")
            .withColumn("last_contacted", F.coalesce("_at", "last_contacted"))
            .select(*contacts.columns))


def touch(df: DataFrame, changed: Column, as_of) -> DataFrame:
    """``updated_at`` of the changed rows becomes ``as_of``."""
    return df.withColumn("updated_at", F.when(changed, moment(as_of)).otherwise(F.col("updated_at")))


def apply_patch(df: DataFrame, patch: DataFrame, key: list[str], as_of=None,
                fixed: dict[str, Column] | None = None, seq: str | None = None) -> DataFrame:
    """Partial update: only the given fields change.

    ``patch`` holds ``key``, the new values, and ``fields``, the names of the columns given (a given
    NULL is stored). Several patches of one row are folded field by field in ``seq`` order. ``fixed``
    sets further columns of every patched row. ``key`` should include the owner.
    """
    fields = [c for c in patch.columns if c not in (*key, "fields", seq)]
    order = F.col(seq) if seq else F.lit(0)
    given = lambda c: F.array_contains("fields", c)
    folded = patch.groupBy(*key).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(given(c), order)).alias(f"_{c}") for c in fields],
        F.lit(True).alias("_hit"))
    out = df.join(folded, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    for c in fields:
        new = F.col(f"_{c}")
        out = out.withColumn(c, F.when(new.isNotNull(), new["v"]).otherwise(F.col(c)))
    for c, value in (fixed or {}).items():
        out = out.withColumn(c, F.when(hit, value).otherwise(F.col(c)))
    if as_of is not None and "updated_at" in df.columns:
        out = touch(out, hit, as_of)
    return out.select(*df.columns)


def complete_interviews(interviews: DataFrame, notes: DataFrame) -> DataFrame:
    """Store feedback and rating of held interviews (blank becomes NULL) and mark them completed.

    ``notes``: ``id, user_id, feedback, rating``.
    """
    patch = notes.select(
        "id", "user_id", F.nullif("feedback", F.lit("")).alias("feedback"),
        F.nullif("rating", F.lit(0)).alias("rating"),
        F.array(F.lit("feedback"), F.lit("rating")).alias("fields"))
    return apply_patch(interviews, patch, ["id", "user_id"], fixed={"status": F.lit("completed")})


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str],
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace rows of ``old`` that ``new`` has by key, append the rest of ``new``.

    ``new`` has one row per key. Columns in ``keep`` stay as they were in ``old`` (an id, a creation
    time). When ``new`` is the small side its keys are broadcast by the optimiser and ``old`` is not
    shuffled.
    """
    untouched = old.join(new.select(*key), key, "left_anti")
    kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in keep])
    merged = new.join(kept, key, "left")
    for c in keep:
        value = F.col(f"_{c}")
        merged = merged.withColumn(c, F.coalesce(value, F.col(c)) if c in new.columns else value)
    return untouched.select(*old.columns).unionByName(merged.select(*old.columns))


def set_purchased(lists: DataFrame, changes: DataFrame, as_of=None) -> DataFrame:
    """Set ``purchased`` of all items with a name, whatever their unit.

    ``changes``: ``id, user_id, item_name, purchased``; one change per list and name. A list's
    changes are bounded by its own distinct item names (others are dropped before collecting).
    """
    keys = ["id", "user_id"]
    names = (lists.select(*keys, F.explode(F.array_distinct(F.transform("items", lambda i: i["name"])))
                          .alias("item_name")))
    wanted = (changes.groupBy(*keys, "item_name").agg(F.max("purchased").alias("purchased"))
              .join(names, [*keys, "item_name"], "left_semi")
              .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("item_name", "purchased")))
                                  .alias("_set")))
    new_items = F.transform("items", lambda i: i.withField(
        "purchased", F.coalesce(F.try_element_at("_set", i["name"]), i["purchased"])))
    out = lists.join(wanted, keys, "left").withColumn(
        "items", F.when(F.col("_set").isNotNull(), new_items).otherwise(F.col("items")))
    if as_of is not None:
        out = touch(out, F.col("_set").isNotNull(), as_of)
    return out.select(*lists.columns)


def cascade(child: DataFrame, deleted: DataFrame, on: tuple[str, str], action: str = "cascade") -> DataFrame:
    """Children after their parents were deleted: removed, or unlinked with ``set_null``.

    ``on`` is (child column, parent column). Chain calls for deeper levels: the removed children are
    ``child.join(deleted, …, 'left_semi')``.
    """
    column, parent = on
    gone = deleted.select(F.col(parent).alias("_gone")).distinct()
    if action == "cascade":
        return child.join(gone, F.col(column) == F.col("_gone"), "left_anti")
    if action != "set_null":
        raise ValueError(f"unknown action {action!r}")
    return (child.join(gone, F.col(column) == F.col("_gone"), "left")
            .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
            .select(*child.columns))


def latest_edit(messages: DataFrame, update_on_edit: bool = True) -> DataFrame:
    """Captured messages after edits: the newest version per message, or every version.

    ``messages``: ``channel, message_id, edited_at, …``.
    """
    if not update_on_edit:
        return messages
    rest = [c for c in messages.columns if c not in ("channel", "message_id")]
    # The whole row breaks ties, so equal edit times give the same answer on every run.
    return latest_per(messages, ["channel", "message_id"], ["edited_at", *[c for c in rest if c != "edited_at"]],
                      rest).select(*messages.columns)


def merge_inventories(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two passes of an inventory merged; an entry found by both comes from the first."""
    both = first.withColumn("_pass", F.lit(1)).unionByName(second.withColumn("_pass", F.lit(2)))
    rest = [c for c in first.columns if c not in key]
    picked = F.min_by(F.struct(*rest) if rest else F.lit(0), F.struct("_pass", *rest)).alias("_row")
    merged = both.groupBy(*key).agg(picked)
    return merged.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*first.columns)
