"""Column functions, one case per documented quirk."""

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from keepsake.functions import dates, predicates, text, vectors
from keepsake.functions.order import pg_asc, pg_desc


@pytest.mark.parametrize("doc, wanted, expected", [
    ('{"source":"slack","n":1}', {}, True),
    ('{"source":"slack","n":1}', {"source": "slack"}, True),
    ('{"source":"slack"}', {"source": "Slack"}, False),
    ('{"topics":["a","b"]}', {"topics": ["a"]}, True),
    ('{"topics":["a","b"]}', {"topics": ["b", "a", "a"]}, True),
    ('{"topics":["ab"]}', {"topics": ["a"]}, False),
    ('{"topics":"a"}', {"topics": ["a"]}, False),
    ('{"topics":["a"]}', {"topics": "a"}, False),
    ('{"o":{"x":1,"y":2}}', {"o": {"x": 1}}, True),
    ('{"o":{"x":1,"y":2}}', {"o": {}}, True),
    ('{"o":[1]}', {"o": {}}, False),
    ('{"o":{"x":1.0}}', {"o": {"x": 1}}, True),
    ('{"o":"1"}', {"o": 1}, False),
    ('{"o":1}', {"o": True}, False),
    ('{"o":true}', {"o": True}, True),
    ('{"a":[{"x":1,"z":[1,2]},{"x":2}]}', {"a": [{"z": [2]}]}, True),
    ('{"a":[{"x":1},{"z":2}]}', {"a": [{"x": 1, "z": 2}]}, False),
    ('{"a":null}', {"a": None}, True),
    ('{}', {"a": None}, False),
    ('not json', {"a": 1}, False),
    ('{"a\'b.c":"v"}', {"a'b.c": "v"}, True),
    ('{"n":1.5}', {"n": 1.5}, True),
])
def test_document_containment(evaluate, doc, wanted, expected):
    assert evaluate(predicates.json_contains(F.lit(doc), wanted)) is expected


def test_promoted_key_is_a_plain_column_test(spark):
    df = spark.createDataFrame([("a", '{"source":"a"}'), (None, "{}")], "source string, metadata string")
    kept = df.where(predicates.json_contains("metadata", {"source": "a"}, {"source": "source"}))
    assert kept.count() == 1
    assert "parse_json" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_variant_column_containment(spark):
    df = spark.sql("select parse_json('{\"a\":[1,2]}') as v")
    assert df.where(predicates.json_contains("v", {"a": [2]}, is_variant=True)).count() == 1


@pytest.mark.parametrize("value, q, expected", [
    ("Blue Paint", "paint", True), ("Blue Paint", "b_ue", True), ("100%", "0\\%", True), ("1000", "0\\%", False),
    (None, "x", False), ("abc", "a\\bc", True), ("ÉCOLE", "école", True)])
def test_substring_search(evaluate, value, q, expected):
    assert evaluate(predicates.ilike_contains(F.lit(value).cast("string"), q)) is expected


def test_any_column_search_skips_nulls(spark):
    df = spark.createDataFrame([(1, None, "Kitchen"), (2, None, None), (3, "kit", None)], "id int, a string, b string")
    assert {r.id for r in df.where(predicates.ilike_any(["a", "b"], "KIT")).collect()} == {1, 3}


def test_tags_must_all_be_present(spark):
    df = spark.createDataFrame([(1, ["ai", "conference"]), (2, ["ai"]), (3, None)], "id int, tags array<string>")
    assert [r.id for r in df.where(predicates.contains_all("tags", ["conference", "ai"])).collect()] == [1]
    assert {r.id for r in df.where(predicates.contains_all("tags", [])).collect()} == {1, 2}


def test_ingredient_name_is_exact(spark):
    df = spark.sql("select array(named_struct('name','Rice','quantity','1','unit','cup')) as i")
    assert df.where(predicates.has_ingredient_named("i", "Rice")).count() == 1
    assert df.where(predicates.has_ingredient_named("i", "rice")).count() == 0


def test_null_placement(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, v string")
    assert [r.id for r in df.orderBy(pg_asc("v")).collect()] == [2, 3, 1]
    assert [r.id for r in df.orderBy(pg_desc("v")).collect()] == [1, 3, 2]


# ── dates ────────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("start, as_of, expected", [
    (date(2000, 5, 10), "2024-05-10", date(2024, 5, 10)),
    (date(2000, 5, 10), "2024-05-11", date(2025, 5, 10)),
    (date(2020, 2, 29), "2023-01-01", date(2023, 2, 28)),
    (date(2020, 2, 29), "2024-01-01", date(2024, 2, 29)),
    (date(2030, 1, 1), "2024-01-01", date(2030, 1, 1)),
])
def test_next_yearly(evaluate, start, as_of, expected):
    assert evaluate(dates.next_yearly(F.lit(start), as_of)) == expected


def test_epoch_date(evaluate):
    assert evaluate(dates.epoch_date(F.lit(1700000000.5))) == "2023-11-14"
    assert evaluate(dates.epoch_date(F.lit(0))) == "unknown"
    assert evaluate(dates.epoch_date(F.lit(None))) == "unknown"


def test_plus_days(evaluate):
    assert evaluate(dates.plus_days(F.lit("2024-01-31").cast("timestamp"), 90)) == datetime(2024, 4, 30)
    assert evaluate(dates.plus_days(F.lit("2024-01-31").cast("timestamp"), F.lit(None).cast("int"))) is None
    assert evaluate(dates.reminder_date(F.lit(date(2024, 3, 1)), 7)) == date(2024, 2, 23)


# ── text ─────────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("raw", ["a b  c\n", "a b", "", "  ", "x y\tz", "one\x1ctwo", "---\nq"])
def test_words_and_strip_follow_unicode_whitespace(evaluate, raw):
    assert evaluate(text.word_count(F.lit(raw))) == len(raw.split())
    assert evaluate(text.strip(F.lit(raw))) == raw.strip()
    assert evaluate(text.is_blank(F.lit(raw))) is (raw.strip() == "")


@pytest.mark.parametrize("title, expected", [
    ("Haiku about rain", True), ("What is water in español", True), ("Image of a cat", True), ("generate an image", True),
    ("Budget plan", False), ("what is this very long question about nothing in spanish", False), (None, False)])
def test_trivial_titles(evaluate, title, expected):
    assert evaluate(text.trivial_title(F.lit(title).cast("string"))) is expected


@pytest.mark.parametrize("raw, expected", [
    ("1700000000", "1700000000"), ("1.700000000123456E9", "1700000000.123456"), ("1.7E9", "1700000000.0"),
    ("1700000000.5", "1700000000.5")])
def test_number_text(evaluate, raw, expected):
    assert evaluate(text.number_text(F.lit(raw))) == expected


def test_conv_hash(evaluate):
    expected = hashlib.sha256("Café|1700000000.5".encode()).hexdigest()[:16]
    assert evaluate(text.conv_hash(F.lit("Café"), F.lit("1700000000.5"))) == expected


def test_chat_metadata(evaluate):
    import json
    with_id = json.loads(evaluate(text.chat_metadata(F.lit("abc"), F.lit("T"), F.lit("2024-01-01"))))
    assert with_id == {"source": "chatgpt", "chatgpt_title": "T", "chatgpt_date": "2024-01-01", "conversation_id": "abc",
                       "conversation_url": "https://chatgpt.com/c/abc"}
    assert "conversation_url" not in json.loads(evaluate(text.chat_metadata(F.lit(""), F.lit("T"), F.lit("unknown"))))


def test_source_keys_win_over_extracted_ones(evaluate):
    import json
    merge = lambda raw: json.loads(evaluate(text.merge_metadata(F.lit(raw), {"source": F.lit("slack"), "slack_ts": F.lit("1.2")})))
    assert merge('{"topics":["a"],"source":"x","n":1.5}') == {"topics": ["a"], "n": 1.5, "source": "slack", "slack_ts": "1.2"}
    fallback = {"topics": ["uncategorized"], "type": "observation", "source": "slack", "slack_ts": "1.2"}
    assert merge("{broken") == fallback
    assert merge("[1]") == fallback


@pytest.mark.parametrize("capture, kind, people, topics, actions, days", [
    ("Decision: Rent the north depot from 2026-03-15. Context: cheaper fuel. Owner: Ilse.", "task", ["Ilse"], ["uncategorized"], [], ["2026-03-15"]),
    ("Decision: Paint it green. Owner: Ann and Bo, Cy.", "task", ["Ann", "Bo", "Cy"], ["uncategorized"], [], []),
    ("Mateus — plays the cello on Thursdays.", "person_note", ["Mateus"], ["uncategorized"], [], []),
    ("Yuki Tan — back in May. #people", "person_note", ["Yuki Tan"], ["people"], [], []),
    ("Insight: late ferries keep regulars away. Triggered by: a tide table.", "idea", [], ["uncategorized"], [], []),
    ("Meeting with harbour crew about winter berths. Key points: x. Action items: tar the ropes, count buoys.", "observation",
     ["harbour crew"], ["winter berths"], ["tar the ropes", "count buoys"], []),
    ("Saving from an almanac: a table of frost dates.", "reference", [], ["uncategorized"], [], []),
    ("Just a note", "observation", [], ["uncategorized"], [], []),
    ("lower — case is not a name", "observation", [], ["uncategorized"], [], []),
    (None, "observation", [], ["uncategorized"], [], []),
])
def test_template_tagging(evaluate, capture, kind, people, topics, actions, days):
    row = evaluate(text.tag_text(F.lit(capture).cast("string")))
    assert (row["type"], row["people"], row["topics"], row["action_items"], row["dates_mentioned"]) == (kind, people, topics, actions, days)


def test_clean_note(evaluate):
    raw = "---\ntitle: x\n---\n# Greenhouse\n[[Odile Varga]] repaired the [[North Pump|pump]] today.\n#water #repairs"
    row = evaluate(text.clean_note(F.lit(raw)))
    assert row["text"] == "# Greenhouse\nOdile Varga repaired the pump today.\nwater repairs"
    assert row["tags"] == ["water", "repairs"]


def test_row_sentence(spark):
    df = spark.createDataFrame([("a", None, 3, " ")], "name string, gone string, n int, blank string")
    assert df.select(text.row_sentence(df.columns).alias("v")).first().v == "name: a. n: 3"


def _packed(raw: str, limit: int) -> list[str]:
    """Brute force: the longest piece that ends at a line break, else a hard cut."""
    out, at = [], 0
    while at < len(raw):
        ends = [e for e in range(at + 1, min(at + limit, len(raw)) + 1) if e == len(raw) or raw[e] == "\n"]
        if ends:
            out.append(raw[at:ends[-1]])
            at = ends[-1] + 1
        else:
            out.append(raw[at:at + limit])
            at += limit
    return [p.strip("\n") for p in out if p.strip("\n")]


@pytest.mark.parametrize("raw", ["aaa\nbbb\ncccccccccccc\n\nd", "", "\n\n", "short", "x" * 30, "one two\nthree\n\n\nfour five six\nseven",
                                 "é" * 9 + "\n" + "ü" * 3, "ab\ncd\nef\ngh\n"])
def test_chunks_match_brute_force(evaluate, raw):
    assert evaluate(text.chunk_array(F.lit(raw), 7)) == _packed(raw, 7)


def test_preview_and_truncate(evaluate):
    assert evaluate(text.preview(F.lit("é" * 201))) == "é" * 200 + "..."
    assert evaluate(text.preview(F.lit("é" * 200))) == "é" * 200
    assert evaluate(text.truncate(F.lit("😀abc"), 2)) == "😀a"


# ── vectors ──────────────────────────────────────────────────────────────────────────────────────


def test_cosine_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (6, [3.0, 4.0])],
                               "id int, e array<float>")
    query = [1.0, 0.0]
    by_column = {r.id: r.s for r in df.select("id", vectors.cosine("e", F.array(F.lit(1.0), F.lit(0.0))).alias("s")).collect()}
    by_batch = {r.id: r.s for r in df.select("id", vectors.similarity_to("e", query).alias("s")).collect()}
    for found in (by_column, by_batch):
        assert found[1] == pytest.approx(1.0) and found[6] == pytest.approx(0.6)
        assert [found[i] for i in (2, 3, 4, 5)] == [None] * 4
