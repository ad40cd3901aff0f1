"""Text functions: chat-import columns, template tagging, note cleaning and chunking.

All of them are JVM expressions over whole texts; none needs Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of conversations that carry no lasting knowledge.
TRIVIAL_TITLE_PATTERN = (
    r"do not remember|forget this|don't remember|ignore this"
    r"|limerick|haiku|poem |joke |riddle"
    r"|image of|generate.*image|draw |create.*art"
    r"|tooth fairy|santa letter|bedtime stor"
    r"|translate this|what is .{1,15} in \w+"
)

# Formats shared with tables written by other tools.
CONVERSATION_URL = "https://chatgpt.com/c/"
MESSAGE_SEPARATOR = "\n---\n"

# What a capture gets when its extracted metadata cannot be parsed.
FALLBACK_METADATA = '{"topics":["uncategorized"],"type":"observation"}'

TAG_KEYS = ("people", "action_items", "dates_mentioned", "topics", "type")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that count as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WORD = r"(?U)[^\s\x1c-\x1f]+"


def strip(c) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces and line breaks included."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """NULL, empty, or nothing but whitespace."""
    return ~F.coalesce(_col(c).rlike(_WORD), F.lit(False))


def word_count(c) -> Column:
    """Words separated by Unicode whitespace (no-break space included)."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(_WORD))


def trivial_title(c) -> Column:
    """True when a title looks like a throw-away conversation."""
    return F.coalesce(_col(c), F.lit("")).rlike(f"(?iU){TRIVIAL_TITLE_PATTERN}")


def number_text(raw) -> Column:
    """Text of a JSON number as the importer hashes it: integers as they are, decimals in plain
    notation with at least one digit after the point."""
    r = _col(raw)
    plain = F.regexp_replace(r.cast("double").cast("string").cast("decimal(30,9)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(r.rlike(r"^-?\d+$"), r).otherwise(plain)


def conv_hash(title_text, time_text) -> Column:
    """First 16 hex digits of SHA-256 over ``title|create_time``."""
    return F.left(F.sha2(F.concat(_col(title_text), F.lit("|"), _col(time_text)), 256), F.lit(16))


def thought_content(title, date_text, text) -> Column:
    """Content of an imported thought: its origin in brackets, then the text."""
    return F.concat(F.lit("[ChatGPT: "), _col(title), F.lit(" | "), _col(date_text), F.lit("] "), _col(text))


def truncate(c, n: int) -> Column:
    """The first ``n`` characters (code points)."""
    return F.substring(_col(c), 1, n)


def preview(c, n: int = 200) -> Column:
    """Listing form of a text: cut after ``n`` characters and marked with dots when cut."""
    return F.when(F.length(_col(c)) > n, F.concat(truncate(c, n), F.lit("..."))).otherwise(_col(c))


def chat_metadata(conv_id, title, date_text) -> Column:
    """Metadata document of an imported thought; the URL only when the id is not empty."""
    cid = F.coalesce(_col(conv_id), F.lit(""))
    return F.to_json(F.struct(
        F.lit("chatgpt").alias("source"),
        _col(title).alias("chatgpt_title"),
        _col(date_text).alias("chatgpt_date"),
        cid.alias("conversation_id"),
        F.when(cid != "", F.concat(F.lit(CONVERSATION_URL), cid)).alias("conversation_url"),
    ))


def merge_metadata(raw_json, source: dict) -> Column:
    """Extracted metadata with the source's own keys laid over it, as JSON text.

    Text that is not a JSON object falls back to an uncategorised observation.
    """
    parsed = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    base = F.coalesce(parsed(_col(raw_json)), parsed(F.lit(FALLBACK_METADATA)))
    names = list(source)
    own = _source_map(source)
    kept = F.map_filter(base, lambda k, _: ~k.isin(names)) if names else base
    return F.to_json(F.map_concat(kept, own))


def _source_map(source: dict) -> Column:
    pairs = []
    for name, value in source.items():
        pairs += [F.lit(name), _col(value).cast("variant")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,variant>")


_NAME = r"\p{Lu}[^\s—:.,]*(?: \p{Lu}[^\s—:.,]*)*"


def _names(text: Column) -> Column:
    """People listed in a phrase: separated by commas or ``and``."""
    parts = F.transform(F.split(text, r"\s*,\s*|\s+and\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def tag_text(c) -> Column:
    """Metadata of a capture written in one of the five template forms.

    ``Decision: …  Owner: who.`` is a task of its owner; ``Name — …`` a person note;
    ``Insight: …`` an idea; ``Meeting with who about topic. … Action items: a, b.`` an observation
    with people, topic and actions; ``Saving from X: …`` a reference; anything else an observation.
    ISO dates and ``#tags`` are collected from every form; without a topic the topic is
    ``uncategorized``. The text is expected without surrounding whitespace.
    """
    t = F.coalesce(_col(c), F.lit(""))
    none = F.array().cast("array<string>")
    decision, insight = t.rlike(r"^Decision:"), t.rlike(r"^Insight:")
    meeting, saving = t.rlike(r"^Meeting with .+? about "), t.rlike(r"^Saving from [^:]+:")
    person = t.rlike(rf"^{_NAME} — ")
    kind = (F.when(decision, "task").when(person, "person_note").when(insight, "idea")
            .when(meeting, "observation").when(saving, "reference").otherwise("observation"))
    people = (F.when(decision, _names(F.regexp_extract(t, r"Owner:\s*([^.]+)", 1)))
              .when(person, F.array(F.regexp_extract(t, rf"^({_NAME}) — ", 1)))
              .when(meeting, _names(F.regexp_extract(t, r"^Meeting with (.+?) about ", 1)))
              .otherwise(none))
    actions = F.split(F.regexp_extract(t, r"(?s)Action items:\s*(.+?)\.?\s*\z", 1), r"\s*[,;]\s*")
    actions = F.when(meeting, F.filter(actions, lambda a: a != "")).otherwise(none)
    tags = F.regexp_extract_all(t, F.lit(r"(?:^|\s)#([\p{L}\d_-]+)"), F.lit(1))
    topic = F.when(meeting, F.array(F.regexp_extract(t, r"^Meeting with .+? about ([^.]+)", 1))).otherwise(none)
    topics = F.array_distinct(F.concat(topic, tags))
    topics = F.when(F.size(topics) == 0, F.array(F.lit("uncategorized"))).otherwise(topics)
    dates = F.regexp_extract_all(t, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    return F.struct(people.alias("people"), actions.alias("action_items"), dates.alias("dates_mentioned"),
                    topics.alias("topics"), kind.alias("type"))


def clean_note(c) -> Column:
    """A markdown note without its artefacts: struct of ``text`` and ``tags``.

    Front matter is removed, ``[[page]]`` and ``[[page|shown]]`` become plain words, ``#tag``
    becomes the word and is listed in ``tags`` (headings are not tags).
    """
    body = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\A---\r?\n(?s:.*?)\r?\n---\r?\n", "")
    tags = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:^|\s)#([\p{L}\d_/-]+)"), F.lit(1)))
    body = F.regexp_replace(body, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    body = F.regexp_replace(body, r"(^|\s)#([\p{L}\d_/-]+)", "$1$2")
    return F.struct(strip(body).alias("text"), tags.alias("tags"))


def row_sentence(cols) -> Column:
    """A table row as one readable line, ``column: value. column: value``; empty fields left out."""
    parts = []
    for name in cols:
        value = F.col(name).cast("string")
        parts.append(F.when(~is_blank(value), F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(". ", *parts)


def chunk_array(c, max_chars: int = 800) -> Column:
    """Whole text as an array of chunks of at most ``max_chars`` characters.

    Paragraphs (lines) are packed greedily; only a paragraph longer than the limit is split inside.
    One linear regular-expression pass, so a long document needs neither a shuffle nor Python.
    """
    pattern = rf"(?s).{{1,{max_chars}}}(?:\n|\z)|.{{1,{max_chars}}}"
    pieces = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), F.lit(0))
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, r"^\n+|\n+\z", ""))
    return F.filter(trimmed, lambda p: p != "")
