"""Chat export: readers, message walk, gate, limit, sinks, ledger, incremental import."""

import hashlib
import json
import tracemalloc
import uuid
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake.operators import answers, hooks, importer
from keepsake.sources import imports, sinks
from keepsake.sources import chat_export
from keepsake.sources.chat_export import read_chat_export
from keepsake.streaming import capture


def node(parent, children, role="user", parts=None, kind="text", message=True):
    out = {"parent": parent, "children": children}
    if message:
        out["message"] = {"author": {"role": role}, "content": {"content_type": kind, "parts": parts or []}}
    return out


def chain(texts, roles=("user", "assistant")):
    return {f"n{i}": node(f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < len(texts) else [], roles[i % len(roles)], [t])
            for i, t in enumerate(texts)}


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def conversation(title="Plan", created=1700000000, mapping=None, **more):
    return {"id": "c1", "title": title, "create_time": created, "mapping": mapping or chain([words(20), "a", "b", "c"]), **more}


def write(folder, name, payload):
    (folder / name).write_text(json.dumps(payload), encoding="utf-8")


@pytest.fixture
def decide(spark, tmp_path):
    def run(conversations, **options):
        write(tmp_path, "conversations.json", conversations)
        rows = importer.with_user_text(importer.walk_messages(read_chat_export(spark, str(tmp_path))))
        return importer.gate_conversations(rows, **options)
    return run


def reasons(decided):
    return [r.skip_reason for r in decided.orderBy("position").collect()]


def test_reader_takes_matching_array_files_only(spark, tmp_path):
    write(tmp_path, "conversations.json", [conversation("a")])
    write(tmp_path, "conversations-001.json", [conversation("b"), conversation("c")])
    write(tmp_path, "conversations-x.json", [conversation("no")])
    write(tmp_path, "conversations-002.json", {"title": "an object"})
    write(tmp_path, "conversations-003.json", [])
    write(tmp_path, "user.json", [conversation("no")])
    assert sorted(r.title for r in read_chat_export(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_reader_takes_files_of_many_lines(spark, tmp_path):
    text = "\ufeff\n " + json.dumps([conversation("a"), conversation("b")], indent=2)
    (tmp_path / "conversations.json").write_text(text, encoding="utf-8")
    assert [r.title for r in read_chat_export(spark, str(tmp_path)).orderBy("position").collect()] == ["a", "b"]


def test_reader_reads_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("inner/conversations-000.json", json.dumps([conversation("a")]))
        z.writestr("conversations.json", json.dumps([conversation("b")]))
        z.writestr("my-conversations.json", json.dumps([conversation("no")]))
    rows = read_chat_export(spark, str(tmp_path / "export.zip"), zipped=True)
    assert sorted(r.title for r in rows.collect()) == ["a", "b"]


def test_reader_errors(spark, tmp_path):
    write(tmp_path, "conversations.json", [])
    with pytest.raises(ValueError):
        read_chat_export(spark, str(tmp_path))
    (tmp_path / "conversations-1.json").write_text('[{"title": ', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_chat_export(spark, str(tmp_path), require_rows=False).collect()


def test_hash_inputs_tell_missing_from_null(spark, tmp_path):
    full = conversation("Café", 1700000000.123456)
    missing = {"mapping": {}}
    null = {"title": None, "create_time": None, "mapping": {}}
    write(tmp_path, "conversations.json", [full, conversation("t", 1700000000), conversation("t", 1700000000.5), missing, null])
    rows = read_chat_export(spark, str(tmp_path)).orderBy("position").collect()
    expected = ["Café|1700000000.123456", "t|1700000000", "t|1700000000.5", "|", "None|None"]
    assert [r.conv_hash for r in rows] == [hashlib.sha256(e.encode()).hexdigest()[:16] for e in expected]
    assert [r.title_shown for r in rows[3:]] == ["(untitled)", "None"]


@pytest.mark.parametrize("mapping, expected", [
    (chain(["a", "b", "c"]), ["a", "b", "c"]),
    ({"root": node(None, ["b", "d"], parts=["a"]), "b": node("root", ["c"], parts=["b"]), "c": node("b", [], parts=["c"]),
      "d": node("root", [], parts=["d"])}, ["a", "b", "c", "d"]),
    ({"y": node(None, [], parts=["1"]), "x": node(None, [], parts=["2"])}, ["1", "2"]),
    ({"a": node("gone", ["b"], parts=["a"]), "b": node("a", ["a", "missing"], parts=["b"])}, ["a", "b"]),
    ({"a": node("b", ["b"], parts=["a"]), "b": node("a", ["a"], parts=["b"])}, []),
    ({"a": node(None, ["b"], message=False), "b": node("a", [], parts=["b"])}, ["b"]),
    ({"a": node(None, [], parts=["x", {"image": 1}, "y"])}, ["x\ny"]),
    (chain([f"m{i}" for i in range(1200)]), [f"m{i}" for i in range(1200)]),
    ({}, []),
])
def test_walk_order(spark, mapping, expected):
    df = spark.createDataFrame([(json.dumps(mapping),)], "mapping string")
    messages = importer.walk_messages(df).first()["messages"]
    assert [m["text"] for m in messages] == expected
    assert [m["pos"] for m in messages] == list(range(len(expected)))


def test_user_text_and_counts(spark):
    mapping = {"a": node(None, ["b"], parts=[" hello there "]), "b": node("a", ["c"], "assistant", ["hi"]),
               "c": node("b", ["d"], parts=["print(1)"], kind="code"), "d": node("c", ["e"], parts=["  "]),
               "e": node("d", [], parts=["more", "text"])}
    df = spark.createDataFrame([(json.dumps(mapping), 1700000000.0)], "mapping string, create_time double")
    row = importer.with_user_text(importer.walk_messages(df)).first()
    assert row.user_text == "hello there\n---\nmore\ntext"
    assert (row.message_count, row.user_words, row.date_text) == (3, len(row.user_text.split()), "2023-11-14")


def test_gate_reasons_in_order(decide):
    few = chain([words(30), "a", "b"])
    decided = decide([
        conversation(), conversation("t2", is_do_not_remember=True, mapping=few), conversation("Haiku about rain", mapping=few),
        conversation("Haiku about rain"), conversation("t5", mapping=chain([words(19), "a", "b"], ("user", "assistant", "assistant"))),
        conversation("t6", mapping=chain([words(19), "a", "b", "c"], ("user", "assistant", "assistant", "assistant"))),
        conversation(None, None)])
    assert reasons(decided) == [None, "do_not_remember", "too_few_messages", "skip_title", "too_few_messages", "too_little_text", None]


def test_gate_dates_are_inclusive_and_ignore_undated(decide):
    day = lambda d: int(datetime.fromisoformat(f"{d}T12:00:00+00:00").timestamp())
    decided = decide([conversation("a", day("2024-01-01")), conversation("b", day("2024-01-02")), conversation("c", day("2024-01-03")),
                      conversation("d", day("2024-01-04")), conversation("e", None), conversation("f", 0)],
                     after="2024-01-02", before="2024-01-03")
    assert reasons(decided) == ["before_date_filter", None, None, "after_date_filter", None, None]


def test_gate_ledger_and_repeats(spark, decide):
    first = conversation("same")
    known = hashlib.sha256(b"known|1700000000").hexdigest()[:16]
    ledger = spark.createDataFrame([(known, datetime(2024, 1, 1))], sinks.LEDGER_SCHEMA)
    decided = decide([first, first, conversation("known"), conversation("Haiku"), conversation("Haiku")], ledger=ledger)
    assert reasons(decided) == [None, "already_imported", "already_imported", "skip_title", "skip_title"]
    assert importer.not_imported(decided, ledger).count() == 4


def test_limit_counts_processed_and_stops_there(decide):
    decided = decide([conversation("late skip Haiku", 50), conversation("p1", 10), conversation("Haiku", 15), conversation("p2", 20),
                      conversation("p3", 30), conversation("undated", None)])
    counts = lambda n: {r.reason: r.conversations for r in importer.import_counters(importer.limit_processed(decided, n)).collect()}
    assert counts(0) == {"processed": 4, "skip_title": 2}
    assert counts(1) == {"processed": 1}          # the undated one is the oldest
    assert counts(3) == {"processed": 3, "skip_title": 1}
    assert counts(99) == {"processed": 4, "skip_title": 2}


def test_thoughts_with_a_summariser(spark, decide):
    decided = decide([conversation("one"), conversation("two"), conversation("Haiku")])
    fn = lambda title, day, body: ["first", " ", 5, "second"] if title == "one" else []
    rows = importer.extract_thoughts(decided, fn).orderBy("title_shown", "thought_no").collect()
    assert [(r.title_shown, r.thought_no, r.content) for r in rows] == [
        ("one", 1, "[ChatGPT: one | 2023-11-14] first"), ("one", 2, "[ChatGPT: one | 2023-11-14] second"), ("two", None, None)]


def test_raw_thought_is_the_whole_text(decide):
    body = "x " * 30_000 + "end"
    rows = importer.extract_thoughts(decide([conversation(mapping=chain([body, "a", "b", "c"]))])).collect()
    assert len(rows) == 1 and rows[0].content.endswith("x end\n---\nb")


def test_summariser_input_limit(spark):
    df = spark.createDataFrame([("t", "d", "x" * 7000)], "title_shown string, date_text string, user_text string")
    fn = lambda title, day, body: [str(len(body))]
    assert hooks.summarise(df, fn, hooks.SUMMARY_INPUT_CHARS).first().thoughts == ["6000"]
    assert hooks.summarise(df, fn).first().thoughts == ["7000"]


def test_embedder_failures_are_rejected(spark, tmp_path):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, content string")
    fn = lambda texts: [None if t == "bad" else [1.0, 2.0] for t in texts]
    good, bad = sinks.write_thoughts(hooks.embed(df, fn), str(tmp_path / "t"))
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]


def test_default_embedder_is_unit_length(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "content string")
    rows = [r.embedding for r in hooks.embed(df, dim=8).collect()]
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0) and rows[1] is None and rows[2] is None


def test_ledger_needs_every_thought(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.read_ledger(spark, path).count() == 0
    results = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", None)], "conv_hash string, ok boolean")
    ledger = sinks.update_ledger(results, path, "2024-02-01")
    assert {r.conv_hash for r in ledger.collect()} == {"a", "c"}
    sinks.update_ledger(spark.createDataFrame([("b", True)], "conv_hash string, ok boolean"), path, "2024-02-02")
    assert sinks.read_ledger(spark, path).count() == 3


def test_totals_cost_report_and_payload(spark, decide, tmp_path):
    decided = decide([conversation("one"), conversation("two"), conversation("Haiku"), conversation("one")])
    thoughts = importer.extract_thoughts(decided)
    stored = thoughts.withColumn("ok", F.col("title_shown") == "one")
    totals = importer.import_totals(decided, stored).first().asDict()
    assert totals == {"total": 4, "already_imported": 1, "filtered": 1, "processed": 2, "user_words": 44, "thoughts": 2, "ingested": 1, "errors": 1}
    cost = importer.import_cost(importer.import_totals(decided, thoughts)).first()
    assert cost.summary_cost == pytest.approx(2 * (800 * 0.15 + 200 * 0.60) / 1e6)
    assert cost.embedding_cost == pytest.approx(2 * 100 * 0.02 / 1e6)
    assert importer.import_cost(importer.import_totals(decided, thoughts), raw=True).first().summary_cost == 0
    counters, detail = importer.import_report(decided, thoughts)
    sinks.write_report(counters, detail, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "conversations")).count() == 2
    body = json.loads(sinks.to_ingest_payload(thoughts.where("title_shown = 'one'")).first().value)
    assert body["source"] == "chatgpt" and body["extra_metadata"]["source_ref"]["chatgpt_title"] == "one"
    assert set(body["extra_metadata"]) == {"chatgpt_title", "chatgpt_create_time", "chatgpt_conversation_hash", "source_ref"}
    assert body["full_text"].startswith("w0 w1")


def test_run_import_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "conversations.json", [conversation("one"), conversation("fails"), conversation("Haiku"), conversation("one"),
                                                  conversation("nothing to keep")])
    out = str(tmp_path / "out")
    fn = lambda title, day, body: [] if title.startswith("nothing") else [f"{title} 1", f"{title} 2"]
    good = lambda texts: [None if "fails 2" in t else [1.0] for t in texts]
    load = lambda **o: importer.run_import(read_chat_export(spark, str(tmp_path / "in")), out, "2024-02-01", fn=fn, embedder=good, **o).first()
    dry = load(dry_run=True)
    assert (dry.total, dry.processed, dry.thoughts, dry.ingested) == (5, 3, 4, 0) and dry.summary_cost > 0
    first = load()
    assert (first.processed, first.already_imported, first.thoughts, first.ingested, first.errors) == (3, 1, 4, 3, 1)
    assert sinks.read_ledger(spark, out + "/ledger").count() == 2
    second = load(limit=5)
    assert (second.already_imported, second.processed, second.filtered) == (3, 1, 1)
    stored = spark.read.parquet(out + "/thoughts").where("outcome = 'accepted'")
    assert sorted(r.thought for r in stored.collect()) == ["fails 1", "one 1", "one 2"]   # nothing twice


def test_incremental_import_resumes_and_repeats_nothing(spark, tmp_path):
    exports, out, state = tmp_path / "exports", str(tmp_path / "out"), str(tmp_path / "state")
    exports.mkdir()
    run = lambda: capture.import_incremental(capture.export_texts(spark, str(exports)), out, state, "2024-02-01", dim=8).awaitTermination()
    write(exports, "conversations.json", [conversation("one"), conversation("Haiku")])
    run()
    assert capture.imported_thoughts(spark, out).count() == 1
    run()
    assert capture.imported_thoughts(spark, out).count() == 1
    write(exports, "conversations-001.json", [conversation("one"), conversation("two")])
    run()
    assert sorted(r.title_shown for r in capture.imported_thoughts(spark, out).collect()) == ["one", "two"]


def test_summariser_runs_once_per_conversation(spark, tmp_path):
    calls, out = tmp_path / "calls", str(tmp_path / "out")
    (tmp_path / "in").mkdir()

    def fn(title, day, text, log=str(calls)):
        with open(log, "a", encoding="utf-8") as f:
            f.write(title + "\n")
        return [title + " 1", title + " 2"]

    flaky = lambda texts: [None if "b 2" in t else [1.0] for t in texts]
    for names, embedder in ((["a", "b"], flaky), (["a", "b", "c"], lambda texts: [[1.0] for _ in texts])):
        write(tmp_path / "in", "conversations.json", [conversation(n) for n in names])
        importer.run_import(read_chat_export(spark, str(tmp_path / "in")), out, "2024-02-01", fn=fn, embedder=embedder)
    assert sorted(calls.read_text(encoding="utf-8").split()) == ["a", "b", "c"]  # b failed in part and came again
    stored = spark.read.parquet(out + "/thoughts").where("outcome = 'accepted'")
    assert sorted(r.thought for r in stored.collect()) == [f"{n} {k}" for n in "abc" for k in (1, 2)]


@pytest.mark.parametrize("streamed", [False, True])
def test_no_conversation_holds_two_answers(spark, tmp_path, streamed):
    """A summariser that never answers alike, over a failed and a repeated run."""
    calls, out = tmp_path / "calls", str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "conversations.json", [conversation("a"), conversation("b")])

    def fn(title, day, text, log=str(calls)):
        call = uuid.uuid4().hex
        with open(log, "a", encoding="utf-8") as f:
            f.write(title + "\n")
        return [f"{call} first {title}", f"{call} second {title}"]

    for turn, embedder in enumerate((lambda texts: [None if "second b" in t else [1.0] for t in texts], lambda texts: [[1.0] for _ in texts])):
        if streamed:
            capture.import_incremental(capture.export_texts(spark, str(tmp_path / "in")), out, str(tmp_path / f"state{turn}"), "2024-02-01",
                                       fn, embedder).awaitTermination()
        else:
            importer.run_import(read_chat_export(spark, str(tmp_path / "in")), out, "2024-02-01", fn=fn, embedder=embedder)
    assert sorted(calls.read_text(encoding="utf-8").split()) == ["a", "b"]
    stored = (capture.imported_thoughts(spark, out) if streamed else spark.read.parquet(out + "/thoughts").where("outcome = 'accepted'")).collect()
    assert len(stored) == 4 and len({(r.title_shown, r.thought.split()[0]) for r in stored}) == 2


def test_failing_models_are_asked_again_and_not_recorded(spark, tmp_path):
    seen = []

    def third_time(*args):
        seen.append(args)
        if len(seen) < 3:
            raise OSError("no answer")
        return ["x"]

    assert answers.with_retries(third_time, attempts=3, wait=0.0)("t") == ["x"] and len(seen) == 3
    assert answers.with_retries(lambda *a: None, attempts=2, wait=0.0)("t") is None
    df = spark.createDataFrame([(t, "2024-01-01", f"text {t}") for t in ("good", "bad", "empty", "good")], "title_shown string, date_text string, user_text string")
    answer = lambda title, day, text: None if title == "bad" else [] if title == "empty" else [text.upper(), " "]
    ask = lambda fn, **o: sorted(map(tuple, answers.summarise_kept(df, fn, str(tmp_path / "kept"), wait=0.0, **o).select("title_shown", "thoughts").collect()))
    first = [("bad", None), ("empty", []), ("good", ["TEXT GOOD"]), ("good", ["TEXT GOOD"])]
    assert ask(answer) == first
    assert ask(lambda *a: ["late"]) == [("bad", ["late"]), *first[1:]]
    assert ask(lambda *a: ["new"], version="2") == [(t, ["new"]) for t in ("bad", "empty", "good", "good")]


def test_incremental_import_after_a_partial_failure_and_under_a_new_checkpoint(spark, tmp_path):
    exports, out = tmp_path / "exports", str(tmp_path / "out")
    exports.mkdir()

    def run(state, embedder):
        capture.import_incremental(capture.export_texts(spark, str(exports)), out, str(tmp_path / state), "2024-02-01",
                                   lambda title, day, text: [title + " 1", title + " 2"], embedder).awaitTermination()
        return sorted(r.thought for r in capture.imported_thoughts(spark, out).collect())

    write(exports, "conversations.json", [conversation("a"), conversation("b")])
    assert run("one", lambda texts: [None if "b 2" in t else [1.0] for t in texts]) == ["a 1", "a 2", "b 1"]
    write(exports, "conversations-001.json", [conversation("b"), conversation("c")])
    everything = [f"{n} {k}" for n in "abc" for k in (1, 2)]
    whole = lambda texts: [[1.0] for _ in texts]
    assert run("one", whole) == everything
    write(exports, "conversations-002.json", [])
    assert run("two", whole) == everything  # every file comes again, nothing is lost or stored twice


# ── other sources ────────────────────────────────────────────────────────────────────────────────


def test_emails(spark):
    df = spark.createDataFrame([("a@x", "s", datetime(2024, 1, 9, 23), ["l"], "old"), ("b@x", "t", datetime(2024, 1, 10), ["l"], "new"),
                                ("c@x", "u", datetime(2024, 1, 11), [], " \n")], "sender string, subject string, sent_at timestamp, labels array<string>, body string")
    rows = imports.emails_to_thoughts(df, after="2024-01-10").collect()
    assert [r.content for r in rows] == ["new"]
    assert json.loads(rows[0].metadata) == {"source": "gmail", "sender": "b@x", "subject": "t", "date": "2024-01-10T00:00:00Z", "labels": ["l"]}


def test_notes_skip_structure(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nx: 1\n---\n# Title\n[[Ann]] called #people", encoding="utf-8")
    (tmp_path / "b.md").write_text("# Only a heading\n\n---\n", encoding="utf-8")
    rows = imports.notes_to_thoughts(imports.read_notes(spark, str(tmp_path))).collect()
    assert [r.content for r in rows] == ["# Title\nAnn called people"]
    assert json.loads(rows[0].metadata) == {"source": "obsidian", "title": "a", "topics": ["people"]}


def test_rows_and_union(spark):
    df = spark.createDataFrame([("n", 1), (None, None)], "name string, size int")
    rows = imports.rows_to_thoughts(df, ["name", "size"])
    assert [r.content for r in rows.collect()] == ["name: n. size: 1"]
    both = imports.union_sources(rows, spark.createDataFrame([("x", 1)], "content string, extra int"))
    assert both.count() == 2 and "extra" in both.columns


def test_direct_captures(spark):
    df = spark.createDataFrame([("Decision: go. Owner: Ann.", ["work"], None), ("plain", None, None), (" ", ["x"], None)],
                               "thought string, tags array<string>, created_at timestamp")
    found = {r.content: json.loads(r.metadata) for r in imports.captures_to_thoughts(df).collect()}
    assert found["Decision: go. Owner: Ann."]["topics"] == ["work"] and found["Decision: go. Owner: Ann."]["people"] == ["Ann"]
    assert found["plain"]["topics"] == ["uncategorized"] and len(found) == 2


def test_promoted_keys_reach_the_scan(spark, tmp_path):
    from keepsake.operators.retrieval import match_thoughts
    rows = [(i, f"t{i}", '{"source":"%s","type":"idea"}' % ("slack" if i % 2 else "gmail"), [1.0, float(i)], None) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, content string, metadata string, embedding array<float>, created_at timestamp")
    stored, _ = sinks.write_thoughts(df, str(tmp_path / "t"))
    found = match_thoughts(stored, [1.0, 0.0], threshold=0.0, filter={"source": "slack"}, promoted={"source": "source"})
    assert [r.id for r in found.collect()] == [1, 3, 5]
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line)
    assert "EqualNullSafe(source,slack)" in scan and "outcome" in scan.split("PartitionFilters:")[1]


# ── arrays cut into parts ────────────────────────────────────────────────────────────────────────

TRICKY = [{"t": 'a "quoted" } , ] [ {', "n": [1, [2, {"x": "\\"}]]}, {"t": "\\\\"}, {}, [], 7, "plain , text", None,
          {"t": "Zoë, 漢字 }{ \U0001f600", "deep": {"a": {"b": [[], [{}, {"c": "],["}]]}}}, {"t": "x" * 500, "e": "\\\"}\\"}] * 9


@pytest.mark.parametrize("indent, ascii, size, split", [(None, True, 1, 1 << 27), (None, False, 90, 256), (1, False, 40, 333), (None, False, 1 << 20, 1 << 27)])
def test_arrays_are_cut_alike_at_every_size(spark, tmp_path, indent, ascii, size, split):
    (tmp_path / "conversations.json").write_text(json.dumps(TRICKY, indent=indent, ensure_ascii=ascii), encoding="utf-8")
    (tmp_path / "conversations-7.json").write_text("﻿ \n" + json.dumps(TRICKY[::-1], indent=indent, ensure_ascii=ascii) + "\n", encoding="utf-8")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for name in names:
            spark.conf.set(name, split)
        parts, files = chat_export.export_parts(spark, str(tmp_path), size=size)
        rows = parts.collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    for name, expected in (("conversations.json", TRICKY), ("conversations-7.json", TRICKY[::-1])):
        mine = sorted((r for r in rows if r.file.endswith("/" + name)), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(expected)))
        assert [json.loads(r.raw) for r in mine] == expected
    assert [(r.elements, r.state) for r in files.collect()] == [(len(TRICKY), "read")] * 2


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    write(tmp_path, "conversations.json", [conversation(str(i)) for i in range(200)])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for name in names:
            spark.conf.set(name, 4096)
        chunks = chat_export.file_chunks(spark, str(tmp_path), "*.json", chat_export.FILE_PATTERN).select("block").distinct().count()
        rows = read_chat_export(spark, str(tmp_path)).orderBy("position").collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert chunks > 5 and [r.title for r in rows] == [str(i) for i in range(200)]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_members_of_archives_are_cut_alike(spark, tmp_path, size):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("conversations.json", json.dumps(TRICKY))
            z.writestr("in/conversations-1.json", json.dumps([name]))
            z.writestr("conversations-2.json", json.dumps({"no": "array"}))
    parts, files = chat_export.export_parts(spark, str(tmp_path), zipped=True, size=size)
    found = {}
    for r in parts.orderBy("file", "position").collect():
        found.setdefault(r.file.rsplit("/", 1)[-1] if "!in" not in r.file else r.file.rsplit("/", 2)[-2], []).append(json.loads(r.raw))
    assert found == {"one.zip!conversations.json": TRICKY, "two.zip!conversations.json": TRICKY, "one.zip!in": ["one"], "two.zip!in": ["two"]}
    assert sorted((r.elements, r.state) for r in files.collect()) == [(0, "not an array")] * 2 + [(1, "read")] * 2 + [(len(TRICKY), "read")] * 2


@pytest.mark.parametrize("text, elements, state", [
    ("", None, None), (" \n", 0, "not an array"), ("{}", 0, "not an array"), ("[]", 0, "read"), ("﻿ [ \n ] ", 0, "read"), ("[[]]", 1, "read"),
    ("[1]", 1, "read"), ('["]"', 0, "malformed"), ('[{"a": 1}', 0, "malformed"), ('[{"a": "x]', 0, "malformed"), ("[1] x", 0, "malformed")])
def test_states_of_files(spark, tmp_path, text, elements, state):
    (tmp_path / "conversations.json").write_text(text, encoding="utf-8")
    parts, files = chat_export.export_parts(spark, str(tmp_path))
    assert [(r.elements, r.state) for r in files.collect()] == ([] if state is None else [(elements, state)])
    if state == "malformed":
        with pytest.raises(Exception, match="malformed JSON array"):
            parts.collect()
    else:
        assert parts.count() == (elements or 0)


def test_answers_are_passed_on_in_small_parts(spark):
    """3,000 answers of 20 KB in one task: 60 MB if they were all kept until the batch is done."""
    def fn(title, day, text):
        if title == "0":
            tracemalloc.start()
        held = tracemalloc.get_traced_memory()[0]
        if title == "2999":
            tracemalloc.stop()
        return [str(held), chr(97 + int(title) % 26) * 20_000]

    df = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("title_shown"), F.lit("d").alias("date_text"), F.lit("t").alias("user_text"),
                                           F.timestamp_seconds("id").alias("at"))
    rows = hooks.summarise(df, fn).select("title_shown", F.unix_seconds("at").alias("at"), F.col("thoughts")[0].cast("long").alias("held"),
                                    F.length(F.col("thoughts")[1]).alias("n")).collect()
    assert [(r.title_shown, r.at, r.n) for r in rows] == [(str(k), k, 20_000) for k in range(3000)]
    assert max(r.held for r in rows) < 20_000_000
