"""Streams on small file sources, compared with what they should store."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from keepsake.sources import capture as source
from keepsake.streaming import capture

CHANNEL = "C1"


def payload(ts, text="Insight: x. Triggered by: y.", **event):
    return {"type": "event_callback", "event": {"type": "message", "channel": CHANNEL, "text": text, "ts": ts, **event}}


def drop(folder, name, payloads):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(p) for p in payloads))


def start(spark, folder, tmp_path, **options):
    events = source.accept_events(source.slack_events(source.read_capture_stream(spark, str(folder))), CHANNEL)
    sink = str(tmp_path / "sink")
    capture.start_capture(events, sink, str(tmp_path / "state"), dim=8, **options).awaitTermination()
    return spark.read.parquet(sink)


def test_gate_retries_and_restart(spark, tmp_path):
    folder = tmp_path / "in"
    drop(folder, "1.json", [
        payload("1700000000.000100"), payload("1700000000.000100"), payload("1700000001.0", subtype="message_changed"),
        payload("1700000002.0", bot_id="B1"), payload("1700000003.0", text="  \n"), payload("1700000004.0", channel="other"),
        {"type": "url_verification", "challenge": "x"}, payload("1700000005.0", type="reaction_added"),
        payload("1700000006.5", text="Ilse — plays the oboe on Sundays")])
    rows = start(spark, folder, tmp_path).collect()
    found = {json.loads(r.metadata)["slack_ts"]: json.loads(r.metadata) for r in rows}
    assert len(rows) == 2 and set(found) == {"1700000000.000100", "1700000006.5"}
    assert found["1700000006.5"]["people"] == ["Ilse"] and found["1700000000.000100"]["type"] == "idea"
    assert all(m["source"] == "slack" for m in found.values())
    assert sorted(r.created_at for r in rows)[0] == datetime(2023, 11, 14, 22, 13, 20, 100)
    drop(folder, "2.json", [payload("1700000000.000100"), payload("1700000010.0")])   # a late retry and a new message
    assert start(spark, folder, tmp_path).count() == 3


def test_redeliveries_are_kept_without_dedup(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [payload("1700000000.1"), payload("1700000000.1")])
    assert start(spark, tmp_path / "in", tmp_path, dedup=False).count() == 2


def test_custom_tagger_and_embedder(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [payload("1700000000.1", text="a"), payload("1700000001.1", text="b")])
    tagger = lambda text: '{"type":"task","source":"model"}' if text == "a" else "no json"
    rows = start(spark, tmp_path / "in", tmp_path, tagger=tagger, embedder=lambda texts: [[1.0]] * len(texts)).collect()
    found = {r.content: json.loads(r.metadata) for r in rows}
    assert found["a"]["type"] == "task" and found["a"]["source"] == "slack"
    assert found["b"]["topics"] == ["uncategorized"] and all(r.embedding == [1.0] for r in rows)


def test_intake_keeps_every_line(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    good = json.dumps(payload("1700000000.1"))
    lines = [good, good[:-4], "", "  ", "7", "[]", "null", "not json", '{"type": 5, "extra": 1, "event": null}', json.dumps({"event": "text"})]
    (folder / "1.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    run = lambda: capture.start_intake(source.payload_lines(spark, str(folder)), table, state).awaitTermination()
    run()
    run()   # nothing new: nothing stored twice
    rows = spark.read.parquet(table).collect()
    assert sorted(r.line for r in rows if r.state == "malformed") == sorted([good[:-4], "7", "[]", "null", "not json", json.dumps({"event": "text"})])
    assert [r.line for r in rows if r.state == "blank"] == ["", "  "]
    parsed = {r.type: r for r in rows if r.state == "parsed"}
    assert len(parsed) == 2 and parsed["5"].rescued == ["extra"] and parsed["5"].event is None
    assert all(r.file.endswith("/1.json") for r in rows) and len(rows) == len(lines)
    (folder / "2.json").write_text(good + "\n{", encoding="utf-8")
    run()
    events = source.slack_events(capture.parsed_payloads(spark, table))
    sink = str(tmp_path / "sink")
    capture.start_capture(source.accept_events(events, CHANNEL), sink, str(tmp_path / "capture"), dim=8).awaitTermination()
    assert spark.read.parquet(sink).count() == 1 and spark.read.parquet(table).count() == len(lines) + 2


def test_discord_messages(spark):
    df = spark.createDataFrame([("1", "srv", "general", "ann", "Insight: x.", datetime(2024, 1, 1), datetime(2024, 1, 1))], source.DISCORD_MESSAGE)
    events = source.accept_events(source.discord_events(df), ["general", "random"])
    meta = json.loads(capture.captured_thoughts(events, capture.discord_source(), dim=8).first().metadata)
    assert {k: meta[k] for k in ("source", "server", "channel", "author", "timestamp")} == {
        "source": "discord", "server": "srv", "channel": "general", "author": "ann", "timestamp": "2024-01-01T00:00:00Z"}


def test_an_edit_is_no_redelivery(spark):
    at = lambda second: datetime(2024, 1, 1, 0, 0, second)
    rows = [("1", "srv", "c", "ann", "first", at(0), None), ("1", "srv", "c", "ann", "first", at(0), None), ("1", "srv", "c", "ann", "edited", at(0), at(9))]
    events = source.discord_events(spark.createDataFrame(rows, source.DISCORD_MESSAGE))
    assert sorted(r.text for r in capture.dedup_retries(events).collect()) == ["edited", "first"]


def test_edits_over_batches(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    line = lambda i, at, text: {"message_id": i, "server": "s", "channel": "c", "author": "a", "content": text, "timestamp": "2024-01-01T00:00:00",
                                "edited_at": f"2024-01-01T00:00:{at:02d}"}
    run = lambda: capture.apply_edits(spark.readStream.schema(source.DISCORD_MESSAGE).json(folder), table, str(tmp_path / "state")).awaitTermination()
    drop(folder, "1.json", [line("1", 1, "first"), line("1", 3, "third"), line("2", 1, "other")])
    run()
    drop(folder, "2.json", [line("1", 2, "second, late"), line("2", 5, "changed")])
    run()
    assert {r.message_id: r.content for r in capture.read_edited(spark, table).collect()} == {"1": "third", "2": "changed"}
    drop(folder, "1.json", [line("3", 1, "new")])  # the same table under a new checkpoint, whose batches start at 0 again
    os.remove(os.path.join(folder, "2.json"))
    capture.apply_edits(spark.readStream.schema(source.DISCORD_MESSAGE).json(folder), table, str(tmp_path / "other")).awaitTermination()
    assert {r.message_id: r.content for r in capture.read_edited(spark, table).collect()} == {"1": "third", "2": "changed", "3": "new"}


def test_compaction_bounds_the_store_and_changes_no_answer(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    assert capture.compact_edits(spark, table) == 0
    answer = lambda: sorted((r.message_id, r.content) for r in capture.read_edited(spark, table).collect())
    run = lambda: capture.apply_edits(spark.readStream.schema(source.DISCORD_MESSAGE).json(folder), table, str(tmp_path / "state")).awaitTermination()
    for at in range(6):
        drop(folder, f"{at}.json", [{"message_id": str(i), "server": "s", "channel": "c", "author": "a", "content": f"{i} at {at}",
                                     "timestamp": "2024-01-01T00:00:00", "edited_at": f"2024-01-01T00:00:{at:02d}"} for i in range(at % 2, 4)])
        run()
        if at in (2, 5):
            unfinished = os.path.join(table, "query=x", "batch=0")  # no marker: left alone
            spark.read.parquet(table).drop("query", "batch").limit(1).write.mode("overwrite").parquet(unfinished)
            os.remove(os.path.join(unfinished, "_SUCCESS"))
            before = answer()
            assert capture.compact_edits(spark, table) == (3 if at == 2 else 4)
            assert answer() == before and spark.read.parquet(table).where("query <> 'x'").count() == 4 and os.path.isdir(unfinished)
    assert capture.compact_edits(spark, table) == 0
    assert answer() == [("0", "0 at 4"), *((str(i), f"{i} at 5") for i in range(1, 4))]


def test_windows_match_the_batch_form(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [{"created_at": f"2024-01-{d:02d}T{h:02d}:00:00", "topics": ["a", "b"][: 1 + h % 2]} for d in range(1, 6) for h in (3, 9, 23)]
    drop(folder, "1.json", rows[:9])
    schema = "created_at timestamp, topics array<string>"
    batch = {(r.window_start, r.topic): r.captures for r in capture.windowed_digest(spark.createDataFrame(
        [(datetime.fromisoformat(r["created_at"]), r["topics"]) for r in rows], schema)).collect()}
    run = lambda: capture.run_to_end(capture.windowed_digest(spark.readStream.schema(schema).json(folder), "1 day", "1 hour"),
                                     str(tmp_path / "sink"), str(tmp_path / "state"))
    run()
    drop(folder, "2.json", rows[9:])
    closed = {(r.window_start, r.topic): r.captures for r in run().collect()}
    assert closed == {k: v for k, v in batch.items() if k[0] < datetime(2024, 1, 5)}
