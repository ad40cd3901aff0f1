"""Cross-document line frequency: lines that too many documents of a host share go, and so do documents that are
left with too little. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import SPACE_RUN, SPACES, let, whole, word_array, word_count, written

WINDOW = 5


def normalised(line: Column) -> Column:
    """What makes two lines the same: case, white space and the values of digits don't count."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), SPACE_RUN, " ")), "[0-9]", "0")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of five that occur twice or more in the same list.

    Windows are compared by hash, sorted with their places; a place counts if a neighbour in that order has the
    same hash. Only lists with some repeated window are sorted.
    """
    def hashes(w):
        return F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))
        return let(again, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), x - F.get(p, k - 1)))), F.lit(0), lambda a, b: a + b))

    return let(words, lambda w: let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def text_measures(text: Column) -> dict[str, Column]:
    """Counts of one text. Words are runs of anything but ASCII white space."""
    lines = lines_with_words(text)
    return {
        "n_words": word_count(text),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(word_array(text)),
    }


def shared_lines(docs: DataFrame, host: str = "source", min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """``host``, ``line`` (hash), ``n_docs``: the lines found in more documents of a host than ``min_docs`` and than
    ``max_share`` of them. Every row of ``docs`` is a document. Each document gives a line once; counts are
    combined before the shuffle, and only lines above ``min_docs`` meet the sizes of the hosts."""
    each = docs.select(docs[host].alias("host"), F.explode(F.array_distinct(F.transform(
        lines_with_words(whole(docs["text"])), lambda line: F.xxhash64(normalised(line))))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = docs.groupBy(docs[host].alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    return (counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(F.col("n_docs") > max_share * F.col("host_docs"))
            .select(counted["host"], "line", "n_docs"))


def apply_line_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, max_share: float = 0.02,
                     min_words: int = 10, min_left: float = 0.3, max_repeat_percent: int = 20) -> DataFrame:
    """One row per document: ``doc_id, host``, the counts of ``text_measures``, ``base_failed``, ``n_words_left``
    after lines above the limits are removed, ``clean_text`` and ``kept``.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_percent`` percent of them in repeated windows.
    A document is kept if that doesn't hold and at least ``min_words`` words and ``min_left`` of its words remain.

    Null text: an empty one, not kept. Null host: a host of its own. Repeated rows: each is a document and is
    judged alike. An empty table gives no rows; other columns are ignored. Texts stay whole and are never shuffled
    unless ``clean_text`` is asked for: what travels of a document is a hash and a word count per line.
    """
    hot = written(shared_lines(docs, host, min_docs, max_share), "shared-lines")
    text = whole(docs["text"])
    base = docs.select(docs["doc_id"].alias("doc_id"), docs[host].alias("host"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    lines = F.transform(F.split(F.col("text"), "\n"), lambda line: F.struct(
        F.xxhash64(normalised(line)).alias("line"), F.size(F.filter(
            F.split(line, SPACE_RUN), lambda w: w != "")).alias("words")))
    each = base.select("doc_id", "host", "text_hash", F.explode(F.array_distinct(F.transform(
        lines_with_words(F.col("text")), lambda line: F.xxhash64(normalised(line))))).alias("line"))
    found = (each.join(hot, each["host"].eqNullSafe(hot["host"]) & (each["line"] == hot["line"]), "left_semi")
             .groupBy(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "host", "text_hash")])
             .agg(F.collect_set("line").alias("gone")))
    measured = base.select("doc_id", "host", "text_hash", "text",
                           *[c.alias(name) for name, c in text_measures(F.col("text")).items()], lines.alias("lines"))
    joined = measured.join(found, measured["doc_id"].eqNullSafe(found["of_doc_id"])
                           & measured["host"].eqNullSafe(found["of_host"])
                           & (measured["text_hash"] == found["of_text_hash"]), "left")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    left = F.when(F.col("gone").isNull(), F.col("n_words")).otherwise(F.aggregate(
        F.filter("lines", lambda x: ~F.array_contains(gone, x["line"])), F.lit(0), lambda a, x: a + x["words"]).cast("long"))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n"), lambda line: ~F.array_contains(gone, F.xxhash64(normalised(line)))), "\n"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (joined.withColumn("base_failed", failed).withColumn("n_words_left", left).withColumn("clean_text", clean)
            .withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= min_words)
                        & (F.col("n_words_left") >= min_left * F.col("n_words")))
            .select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "n_words_left", "kept", "clean_text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
word AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o)
        AS five FROM word WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY lead(x, 4) OVER o IS NOT NULL),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
line AS (SELECT rid, source, x AS raw, regexp_replace(lower(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11)
        || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
        FROM (SELECT rid, source, unnest(ls) AS x FROM w)),
host AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
hot AS (SELECT l.source, norm FROM line l JOIN host h ON l.source IS NOT DISTINCT FROM h.source
        GROUP BY l.source, norm, host_docs HAVING count(DISTINCT rid) > 20 AND count(DISTINCT rid) > 0.02 * host_docs),
gone AS (SELECT rid, sum(len(list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n
        FROM line l JOIN hot h ON l.source IS NOT DISTINCT FROM h.source AND l.norm = h.norm GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS n_words_left
        FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 10
        AND n_words_left >= 0.3 * n_words) AS kept, n_words_left
FROM m
"""
