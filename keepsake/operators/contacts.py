"""Professional contacts: search, history, follow-ups, bridges to thoughts and job contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions.dates import day, days_from, moment
from keepsake.functions.order import pg_asc
from keepsake.functions.predicates import contains_all, ilike_any, ilike_contains


def search_contacts(contacts: DataFrame, q: str | None = None, tags: list[str] | None = None,
                    how_met: str | None = None) -> DataFrame:
    """Contacts whose name, company, title or notes contain ``q``, carrying all ``tags``, by name.

    ``how_met`` narrows to contacts met in a certain way.
    """
    if q:
        contacts = contacts.where(ilike_any(["name", "company", "title", "notes"], q))
    if tags:
        contacts = contacts.where(contains_all("tags", tags))
    if how_met:
        contacts = contacts.where(ilike_contains("how_we_met", how_met))
    return contacts.orderBy(pg_asc("name"), pg_asc("id"))


def contact_history(contacts: DataFrame, interactions: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Every contact with its interactions and opportunities, as one row per entry.

    Columns: the contact's ``id, user_id, name``, ``interaction_count``, then ``kind``
    (``interaction``, ``opportunity``, or NULL for a contact without entries), ``entry_id, at,
    detail, text``. Sorted by contact, interactions before opportunities, newest first. Rows instead
    of nested arrays keep a contact with very many entries spread over tasks: the counts are combined
    before the shuffle, entries join contacts inner (so that a hot contact's entries can be split), and the sort
    is a range sort over (contact, kind, time).
    """
    counts = interactions.groupBy(F.col("contact_id").alias("id"), "user_id").agg(
        F.count("*").alias("interaction_count"))
    head = (contacts.select("id", "user_id", "name").join(counts, ["id", "user_id"], "left")
            .withColumn("interaction_count", F.coalesce("interaction_count", F.lit(0))))
    calls = interactions.select(
        F.col("contact_id").alias("id"), "user_id", F.lit("interaction").alias("kind"),
        F.col("id").alias("entry_id"), F.col("occurred_at").alias("at"),
        F.col("interaction_type").alias("detail"), F.col("summary").alias("text"))
    deals = opportunities.select(
        F.col("contact_id").alias("id"), "user_id", F.lit("opportunity").alias("kind"),
        F.col("id").alias("entry_id"), F.col("created_at").alias("at"),
        F.col("stage").alias("detail"), F.col("title").alias("text"))
    entries, key = calls.unionByName(deals), ["id", "user_id"]
    filled = entries.join(head, key).select(*head.columns, "kind", "entry_id", "at", "detail", "text")
    bare = head.join(entries.select(*key).distinct(), key, "left_anti")
    return (filled.unionByName(bare, allowMissingColumns=True)
            .orderBy("id", "kind", F.col("at").desc_nulls_first(), "entry_id"))


def follow_ups(contacts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Contacts to follow up until ``days`` days ahead (0 means 7), marked overdue or upcoming."""
    today = day(as_of)
    due = F.col("follow_up_date")
    return (contacts.where(due.isNotNull() & (due <= days_from(today, days or 7)))
            .withColumn("bucket", F.when(due < today, "overdue").otherwise("upcoming"))
            .orderBy(pg_asc("follow_up_date"), pg_asc("id")))


def follow_up_counts(contacts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Overdue and upcoming follow-ups per user."""
    return follow_ups(contacts, as_of, days).groupBy("user_id").agg(
        F.count_if(F.col("bucket") == "overdue").alias("overdue_count"),
        F.count_if(F.col("bucket") == "upcoming").alias("upcoming_count"))


def bridge_contacts(job_contacts: DataFrame, companies: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(new professional contacts, links) for job contacts that are not linked yet.

    The new id is derived from owner and job contact, so a rerun finds the same id. Write ``links``
    back with ``state.apply_patch``.
    """
    role = F.coalesce(F.nullif("role_in_process", F.lit("")), F.lit("contact"))
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    open_ = (job_contacts.where(F.coalesce(F.col("professional_crm_contact_id"), F.lit("")) == "")
             .withColumn("_new", F.sha2(F.concat_ws("|", F.lit("contact"), "user_id", "id"), 256))
             .join(names, "company_id", "left"))
    new = open_.select(
        F.col("_new").alias("id"), "user_id", "name", "company", "title", "email", "phone", "linkedin_url",
        F.concat(F.lit("Job search - "), role).alias("how_we_met"),
        F.array(F.lit("job-hunt"), role).alias("tags"), "notes", "last_contacted",
        moment(as_of).alias("created_at"), moment(as_of).alias("updated_at"))
    links = open_.select(F.col("id"), "user_id", F.col("_new").alias("professional_crm_contact_id"),
                         F.array(F.lit("professional_crm_contact_id")).alias("fields"))
    return new, links


def linked_notes(thoughts: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """One note line per link: ``contact_id, thought_id, line``."""
    line = F.concat(F.lit("\n\n[Linked Thought "), F.date_format(moment(as_of), "yyyy-MM-dd"),
                    F.lit("]: "), F.col("content"))
    return links.join(thoughts.select(F.col("id").alias("thought_id"), "content"), "thought_id").select(
        "contact_id", "thought_id", line.alias("line"))


def append_linked_thoughts(contacts: DataFrame, thoughts: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """Contacts with the linked thoughts appended to their notes, in order of thought id.

    The notes are one text cell, so a contact's new lines must fit one; ``linked_notes`` gives the
    same lines as rows.
    """
    added = linked_notes(thoughts, links, as_of).groupBy(F.col("contact_id").alias("id")).agg(
        F.expr("listagg(line, '') within group (order by thought_id)").alias("_added"))
    return (contacts.join(added, "id", "left")
            .withColumn("notes", F.when(F.col("_added").isNull(), F.col("notes"))
                        .otherwise(F.concat(F.coalesce("notes", F.lit("")), "_added")))
            .select(*contacts.columns))


def _words(text) -> Column:
    """Letters and digits of a text in lower case, as words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named_in_text(names: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Which ``name`` (of the column ``name``) stands in which text, as whole words and in any case: ``thought_id, created_at, name``.

    Every run of as many words as some name has is a key, so texts and names meet in a hash join, however many names
    there are; only the different lengths of names, a handful, are known beforehand. A name without letters and digits is
    found nowhere.
    """
    keyed = names.select("name", _words("name").alias("w")).where(F.size("w") > 0).distinct()
    lengths = sorted(r["n"] for r in keyed.select(F.size("w").alias("n")).distinct().collect())
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size("w") - n + 1)
        return F.when(F.size("w") >= n, F.transform(places, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(none)

    split = thoughts.where(F.col("content").isNotNull()).select(F.col("id").alias("thought_id"), "created_at", _words("content").alias("w"))
    said = split.select("thought_id", "created_at", F.explode(F.array_distinct(F.concat(none, *map(runs, lengths)))).alias("key"))
    return said.join(keyed.select("name", F.array_join("w", " ").alias("key")), "key").select("thought_id", "created_at", "name")


def thoughts_about(contacts: DataFrame, thoughts: DataFrame, n: int = 5, in_text: bool = False) -> DataFrame:
    """The newest ``n`` thoughts that name each contact, with ``rank`` 1 for the newest.

    A thought names a contact if its ``people`` do, or with ``in_text`` also if the name stands in its text. Thoughts are ranked
    per person before they meet the contacts: each task keeps at most ``n`` rows per person ahead of the shuffle, so a name that is
    in a third of all thoughts costs little.
    """
    named = thoughts.select(F.col("id").alias("thought_id"), "created_at",
                            F.explode(F.array_distinct(F.transform("people", F.lower))).alias("_who"))
    if in_text:
        found = named_in_text(contacts.select(F.lower("name").alias("name")), thoughts)
        named = named.unionByName(found.withColumnRenamed("name", "_who")).distinct()
    newest = Window.partitionBy("_who").orderBy(F.col("created_at").desc(), F.col("thought_id").asc())
    top = named.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)
    return (contacts.select(F.col("id").alias("contact_id"), "user_id", "name", F.lower("name").alias("_who"))
            .join(top, "_who").drop("_who"))


def opportunities_by_stage(opportunities: DataFrame) -> DataFrame:
    """Number and value of opportunities by user and stage, with subtotals.

    ``user_id`` and ``stage`` are NULL in subtotal rows (``level`` 1: user total, 3: grand total).
    """
    return opportunities.rollup("user_id", "stage").agg(
        F.count("*").alias("opportunities"), F.sum("value").alias("value"),
        F.grouping_id().cast("bigint").alias("level"))


def staleness(contacts: DataFrame, interactions: DataFrame, as_of, days: int | None = None) -> DataFrame:
    """Days since the last interaction of each contact (NULL: never); ``days`` keeps those at least
    that old, never-contacted ones included."""
    last = interactions.groupBy(F.col("contact_id").alias("id"), "user_id").agg(
        F.max("occurred_at").alias("last_interaction"))
    out = contacts.select("id", "user_id", "name").join(last, ["id", "user_id"], "left").withColumn(
        "days_since", F.datediff(day(as_of), F.to_date("last_interaction")))
    if days is not None:
        out = out.where(F.col("days_since").isNull() | (F.col("days_since") >= days))
    return out
