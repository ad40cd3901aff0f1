import json
from collections import Counter

import duckdb
import pytest

from keepsake.llm import tool_calls as T
from keepsake.llm.queries import QUERIES

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


@pytest.mark.parametrize("value, schema, found", [
    ({"a": 1}, {"type": "object", "required": ["b"]}, "$.b: missing"), (True, {"type": "integer"}, "$: not of type integer"),
    ([1, "x"], {"type": "array", "items": {"type": "number"}}, "$[1]: not of type number"), ("ab", {"type": "string", "maxLength": 1}, "$: maxLength"),
    ({"z": 1}, {"type": "object", "additionalProperties": False}, "$.z: unknown"), (3, {"enum": [1, 2]}, "$: not one of the values"),
    ({"a": [1]}, {"type": "object", "properties": {"a": {"type": "array", "maxItems": 1}}}, None), (5, {"type": "integer", "maximum": 5}, None)])
def test_schema_problems(value, schema, found):
    assert T.problem_of(value, schema) == found


def test_linking_order_and_odd_rows(spark):
    schema = {"go": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}
    calls = spark.createDataFrame([
        (1, 5, "a", "go", '{"n": 1, "b": "é"}', ["b", "c", "gone"], "x"), (1, 3, "b", "go", '{"n": "1"}', ["c"], "x"), (1, 4, "c", "go", '{"n": 2}', [], "x"),
        (1, 6, "c", "go", '{"n": 3}', [], "x"), (2, 1, "p", "go", "{", ["q"], "x"), (2, 2, "q", "other", "{}", ["p"], "x"), (2, 3, "r", "go", None, ["q"], "x"),
        (None, 1, "a", "go", '{"n": 4}', None, "x"), (3, None, None, "go", '{"n": 5}', None, "x"), (4, 1, "s", "go", '{"n":6}', ["s"], "x")], CALLS)
    results = spark.createDataFrame([(1, 7, "a", "done"), (1, 8, "a", "again"), (1, 9, "z", "lost"), (None, 2, "a", None), (5, 1, None, "x")],
                                    RESULTS.rsplit(",", 1)[0])
    rows = T.link_calls(calls, results, schema).collect()
    assert len(rows) == 10 + 5
    found = {(r["conv_id"], r["call_id"], r["role"], r["status"]): r for r in rows}
    order = {k[1]: (r["after"], r["level"]) for k, r in found.items() if k[0] in (1, 2, 4) and k[2:] != ("assistant", "repeated") and k[2] == "assistant"}
    assert order == {"c": (4, 0), "b": (4, 1), "a": (5, 0), "p": (2, None), "q": (2, None), "r": (3, 0), "s": (1, None)}
    assert found[1, "a", "assistant", "linked"]["json"] == (
        '{"role":"assistant","tool_calls":[{"arguments":{"b":"é","n":1},"id":"a","name":"go"}]}')
    assert found[1, "b", "assistant", "no_result"]["problem"] == "$.n: not of type integer"
    assert found[2, "p", "assistant", "no_result"]["problem"] == "$: not JSON"
    assert found[2, "q", "assistant", "no_result"]["problem"] == "unknown tool other"
    assert json.loads(found[1, "a", "tool", "linked"]["json"])["content"] == "done"
    assert {(1, "a", "tool", "repeated"), (1, "c", "assistant", "repeated"), (1, "z", "tool", "orphan"), (3, None, "assistant", "no_id"),
            (5, None, "tool", "no_id"), (None, "a", "assistant", "linked"), (None, "a", "tool", "linked")} <= set(found)


def test_order_of_long_chains_and_later_needs(spark):
    rows = [(1, f"c{i}", i, [f"c{i - 1}"]) for i in range(3000)]  # each needs the one before
    rows += [(2, f"d{i}", i, [f"d{i + 1}", "d0" if i == 5 else "d9"]) for i in range(6)]  # each needs the next
    found = T.dependency_order(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, depends_on array<string>")).collect()
    place = {r["call_id"]: (r["after"], r["level"]) for r in found}
    assert all(place[f"c{i}"] == (i, 0) for i in range(3000))
    assert [place[f"d{i}"] for i in range(6)] == [(5, None)] * 6  # d0 ... d5 -> d0 is a cycle
    chain = [(1, f"e{i}", i, [f"e{i + 1}"]) for i in range(5)]
    found = T.dependency_order(spark.createDataFrame(chain, "conv_id long, call_id string, turn long, depends_on array<string>")).collect()
    assert {r["call_id"]: (r["after"], r["level"]) for r in found} == {f"e{i}": (4, 4 - i) for i in range(5)}


def test_empty_tables(spark):
    assert T.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {}).count() == 0


def test_exact_repeats_keep_a_row_each(spark):
    call, result = (1, 1, "a", "go", "{}", ["b"], None), (1, 2, "a", "done", None)
    calls = spark.createDataFrame([call] * 3 + [(1, 4, "a", "go", "{}", ["b"], None)] * 2 + [(2, None, "n", None, None, None, None)] * 2
                                  + [(None, 1, "m", "go", "{}", [], None)] * 2, CALLS)
    results = spark.createDataFrame([result] * 4 + [(1, 3, "a", "done", None)] * 2 + [(3, 1, "z", "x", None)] * 2, RESULTS)
    found = Counter((r["conv_id"], r["role"], r["turn"], r["status"]) for r in T.link_calls(calls, results, {"go": {}}).collect())
    assert found == {
        (1, "assistant", 1, "linked"): 1, (1, "assistant", 1, "repeated"): 2, (1, "assistant", 4, "repeated"): 2,
        (2, "assistant", None, "no_result"): 1, (2, "assistant", None, "repeated"): 1,
        (None, "assistant", 1, "no_result"): 1, (None, "assistant", 1, "repeated"): 1,
        (1, "tool", 2, "linked"): 1, (1, "tool", 2, "repeated"): 3, (1, "tool", 3, "repeated"): 2, (3, "tool", 1, "orphan"): 2}


def test_exact_repeats_against_sql(spark, folder_of):
    """Without the status: the SQL doesn't tell first and repeated rows apart."""
    rows = [(1, 0, "user", "hi")] + [(1, 1, "assistant", "yes")] * 3 + [(1, 2, "user", "again")] * 3 + [(2, 5, "assistant", "lost")] * 2
    folder = folder_of(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder.removeprefix('file://')}/conversations.parquet/*.parquet'")
    columns = "conv_id, call_id, after, level, turn, role, problem, json"
    asked = con.execute(f"select {columns} from ({T.SQL})").fetchall()
    found = QUERIES["op8_tool_calls"](spark, folder).select(*columns.split(", ")).collect()
    assert len(asked) == len(rows) and sorted(map(tuple, found), key=str) == sorted(asked, key=str)


def test_turns_of_other_roles_are_carried(spark, folder_of):
    rows = [(1, 0, "system", 'be "brief", é'), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, None, "odd"), (1, 4, "tool", None),
            (1, 4, "tool", None), (2, 0, "system", ""), (2, None, None, None), (None, 1, "system", "x")]
    folder = folder_of(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder.removeprefix('file://')}/conversations.parquet/*.parquet'")
    answer = con.execute(T.SQL)
    columns = [c[0] for c in answer.description]
    found = list(map(tuple, QUERIES["op8_tool_calls"](spark, folder).select(*columns).collect()))
    assert len(found) == len(rows) and sorted(found, key=str) == sorted(answer.fetchall(), key=str)
    assert (1, None, 3, 0, 3, None, "other", None, '{"content":"odd","role":null}') in found
    assert (1, None, 0, 0, 0, "system", "other", None, '{"content":"be \\"brief\\", é","role":"system"}') in found


def test_chains_of_later_calls_are_levelled(spark, folder_of):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c, turns in ((1, range(20)), (2, [0, 1, 2, 3, 6, 7, 8, 9]), (3, [4, 8]))
            for t in turns] + [(1, 30, "system", "s")]
    folder = folder_of(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder.removeprefix('file://')}/conversations.parquet/*.parquet'")
    answer = con.execute(T.CHAIN_SQL)
    columns = [c[0] for c in answer.description]
    found = QUERIES["op8_all_messages"](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(answer.fetchall(), key=str)
    assert {(r["turn"], r["after"], r["level"]) for r in found if r["conv_id"] == 1 and r["turn"] < 9 and r["role"] == "assistant"} == {
        (0, 6, 3), (2, 6, 2), (4, 6, 1), (6, 6, 0), (8, 14, 3)}
