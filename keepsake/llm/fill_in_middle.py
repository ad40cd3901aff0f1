"""Fill-in-the-middle: texts cut into prefix, middle and suffix by counted quantifiers, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import whole

UNIT = "(?s)."  # one code point, line ends included
BLOCK = 64
MARKS = ("<P>", "<S>", "<M>")


def count_units(text: Column) -> Column:
    """The number of code points of a text, by ``regexp_count``: whole blocks first, then what is left after them, so
    a long text makes a 64th of the matches."""
    block = f"(?s).{{{BLOCK}}}+"
    left = F.regexp_replace(text, F.lit(block), F.lit(""))
    return (F.regexp_count(text, F.lit(block)) * BLOCK + F.regexp_count(left, F.lit(UNIT))).cast("long")


def cut_pattern(first: Column, second: Column) -> Column:
    """A row's own pattern: ``first`` units, then up to ``second``, then the rest, each a group. The counts are possessive, so
    there is one way to match and no step back."""
    number = lambda n: n.cast("string")
    return F.concat(F.lit(r"(?s)\A(.{"), number(first), F.lit("}+)(.{"), number(second - first), F.lit("}+)(.*+)"))


def draws(doc_id: Column, salt: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers from the document's id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of. The pieces hold no mark, and no mark's end is another's
    beginning, so the first mark of each kind is the one that was put there."""
    psm, spm = (F.lit("(?s)\\A" + "(.*?)".join(order) + "(.*+)") for order in (("<P>", "<S>", "<M>"), ("<S>", "<P>", "<M>")))
    return (F.when(form == "psm", F.regexp_replace(output, psm, F.lit("$1$3$2")))
            .when(form == "spm", F.regexp_replace(output, spm, F.lit("$2$3$1"))).otherwise(output))


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text of n code points is cut at two places drawn from the id. ``form`` is ``plain`` for ``plain_percent`` of the ids and
    for texts that are empty or hold a mark (output: the text; both counts null), ``spm`` (suffix first) for
    ``spm_percent`` of the rest, else ``psm``. One match of the row's pattern captures all three pieces and
    writes the output. All in column functions; nothing is shuffled.

    Null text: empty, so plain. Null doc_id: drawn as if its digits were the empty string. Repeated rows each give
    a row; an empty table gives none. Other columns are ignored. A long text is matched in one pass.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), whole(docs["text"]).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), salt)
    rows = rows.select("doc_id", "text", count_units(F.col("text")).alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
                       F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    pattern, cut = cut_pattern(F.col("first"), F.col("second")), F.col("form") != "plain"
    order = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
                       F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
                       F.when(cut, F.regexp_replace(F.col("text"), pattern, order)).otherwise(F.col("text")).alias("output"))


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
d AS (SELECT doc_id, text, n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              OR CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, least(x, y) AS a, greatest(x, y) AS b, substr(text, 1, least(x, y)) AS prefix,
    substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(text, greatest(x, y) + 1) AS suffix FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                     WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
