"""Tool-call linking: calls meet their results by identifier, in dependency order, as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import same, word_count, written

MESSAGES = ("conv_id long, call_id string, after long, level long, turn long, role string, status string, problem string, json string")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def problem_of(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a JSON value breaks a schema (types, enum, ranges, lengths, pattern, properties, items)."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        right = isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    else:
        right = kind is None or isinstance(value, _TYPES[kind])
    if not right:
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    size = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    length = len(value) if isinstance(value, (str, list)) else None
    for name, broken in (("minimum", lambda m: size is not None and size < m), ("maximum", lambda m: size is not None and size > m),
                         ("minLength", lambda m: isinstance(value, str) and length < m),
                         ("maxLength", lambda m: isinstance(value, str) and length > m),
                         ("maxItems", lambda m: isinstance(value, list) and length > m),
                         ("pattern", lambda m: isinstance(value, str) and not re.search(m, value))):
        if name in schema and broken(schema[name]):
            return f"{at}: {name}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                found = problem_of(value[name], known[name], f"{at}.{name}")
            else:
                found = f"{at}.{name}: unknown" if schema.get("additionalProperties") is False else None
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        return next((p for k, x in enumerate(value) if (p := problem_of(x, schema["items"], f"{at}[{k}]"))), None)
    return None


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and unescaped letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def dependency_order(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, after, level``: sorted by ``after`` and then ``level``, every call comes behind what it needs.

    ``calls`` has ``conv_id, call_id, turn, depends_on`` (array of call ids); unknown ones don't count. ``after`` is the latest
    turn among a call and all it needs, so calls that need earlier ones only, as nearly all do, are in order by
    their own turn and take no further step however long their chain is. ``level`` orders calls with equal ``after``
    that need each other; it is null in a cycle and, at the same ``after``, behind one. Steps are joins on conversation
    and call, so a hot conversation is spread like any other; their number grows with the longest run of
    calls that wait for later turns.
    """
    place = F.coalesce(F.col("turn"), F.lit(-1 << 62)).cast("long")
    nodes = written(calls.groupBy("conv_id", "call_id").agg(F.min(place).alias("after")), "calls")
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    known = nodes.select(F.col("conv_id").alias("of"), F.col("call_id").alias("known"))
    edges = written(edges.join(known, edges["conv_id"].eqNullSafe(known["of"]) & (edges["needs"] == known["known"]), "left_semi"), "needs")

    def with_places(own: DataFrame) -> DataFrame:
        """The edges with the ``after`` of both ends."""
        needed = own.select(F.col("conv_id").alias("of"), F.col("call_id").alias("known"), F.col("after").alias("needed_after"))
        both = edges.join(own, same(edges, own, "conv_id", "call_id")).select(edges["*"], own["after"])
        return both.join(needed, both["conv_id"].eqNullSafe(needed["of"]) & (both["needs"] == needed["known"])).drop("of", "known")

    while True:
        raised = written(with_places(nodes).where("needed_after > after").groupBy("conv_id", "call_id").agg(
            F.max("needed_after").alias("raised")), "raised")
        if raised.isEmpty():
            break
        nodes = written(nodes.join(raised, same(nodes, raised, "conv_id", "call_id"), "left").select(
            nodes["conv_id"], nodes["call_id"], F.coalesce("raised", "after").alias("after")), "calls")
    edges = written(with_places(nodes).where("needed_after = after").select("conv_id", "call_id", "needs"), "needs")
    tied = written(edges.select("conv_id", "call_id").distinct(), "rest")
    levels, rest, level = nodes.join(tied, same(nodes, tied, "conv_id", "call_id"), "left_anti").withColumn("level", F.lit(0).cast("long")), tied, 1
    ready = levels.select("conv_id", "call_id")
    while not rest.isEmpty():
        met = ready.select(F.col("conv_id").alias("of"), F.col("call_id").alias("done"))
        edges = written(edges.join(met, edges["conv_id"].eqNullSafe(met["of"]) & (edges["needs"] == met["done"]), "left_anti"), "needs")
        ready = written(rest.join(edges, same(rest, edges, "conv_id", "call_id"), "left_anti"), "ready")
        if ready.isEmpty():
            break
        done = nodes.join(ready, same(nodes, ready, "conv_id", "call_id"), "left_semi").withColumn("level", F.lit(level).cast("long"))
        levels = levels.unionByName(done)
        rest = written(rest.join(ready, same(rest, ready, "conv_id", "call_id"), "left_anti"), "rest")
        level += 1
    blocked = nodes.join(rest, same(nodes, rest, "conv_id", "call_id"), "left_semi").withColumn("level", F.lit(None).cast("long"))
    return levels.unionByName(blocked).withColumn("after", F.when(F.col("after") > -1 << 62, F.col("after")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None) -> DataFrame:
    """One row per message: a call, a result or another one, ordered by ``conv_id, after, level, turn, call_id, role``.

    ``calls``: ``conv_id, turn, call_id, name, arguments`` (JSON text), ``depends_on`` (array of call ids). ``results``:
    ``conv_id, turn, call_id, content``. ``others``, what is neither: ``conv_id, turn, role, content``; these rows have the status
    ``other``, no call_id and the place of their turn. ``status`` of the rest is ``linked``, ``no_result``, ``orphan`` (a result without its
    call), ``no_id`` or ``repeated``: of several calls, or results, of one id the first by turn and content
    counts, and each further one is a row, also if it equals the first in everything. ``problem`` says how a call's arguments break the schema of its tool, null if they don't. ``json`` is the message
    as canonical JSON; arguments that aren't JSON stay text. A conversation is never collected: its messages are rows.

    Null conv_id: a conversation of its own. Null turn: first. Null arguments or content: JSON null. Empty tables give
    no rows; other columns are ignored.
    """
    key = ["conv_id", "call_id"]
    number = F.monotonically_increasing_id().alias("row")  # written, so it stays: tells equal messages apart
    calls = written(calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", number), "all-calls")
    results = written(results.select("conv_id", "turn", "call_id", "content", number), "all-results")
    named = calls.where("call_id is not null")
    first = named.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on", "row")).alias("c"), F.count(F.lit(1)).alias("n"))
    given = results.where("call_id is not null").groupBy(*key).agg(
        F.min(F.struct("turn", "content", "row")).alias("r"), F.count(F.lit(1)).alias("m"))
    order = dependency_order(first.select(*key, "c.turn", "c.depends_on"))
    pair = (first.join(given, same(first, given, *key), "left")
            .select(first["conv_id"], first["call_id"], "c", "n", "r", "m"))
    pair = written(pair.join(order, same(pair, order, *key)).select(pair["*"], "after", "level"), "linked-calls")
    status = F.when(F.col("r").isNull(), "no_result").otherwise("linked")
    blank = F.lit(None).cast("string")

    def message(df, level, turn, role, status, name=blank, payload=blank):
        return df.select("conv_id", "call_id", *(c.cast("long").alias(n) for n, c in zip(("after", "level"), level)), turn.cast("long").alias("turn"),
                         F.lit(role).alias("role"), status.alias("status"), name.alias("name"), payload.alias("payload"))

    own, no_level = (F.col("after"), F.col("level")), (F.lit(None), F.lit(None))
    orphans = results.join(first, same(results, first, *key), "left_anti").where("call_id is not null")
    messages = message(pair, own, F.col("c.turn"), "assistant", status, F.col("c.name"), F.col("c.arguments"))
    more = [message(pair.where("r is not null"), own, F.col("r.turn"), "tool", F.lit("linked"), payload=F.col("r.content")),
            message(orphans, no_level, F.col("turn"), "tool", F.lit("orphan"), payload=F.col("content")),
            message(calls.where("call_id is null"), no_level, F.col("turn"), "assistant", F.lit("no_id"), F.col("name"), F.col("arguments")),
            message(results.where("call_id is null"), no_level, F.col("turn"), "tool", F.lit("no_id"), payload=F.col("content"))]
    extra_calls = named.join(pair.where("n > 1").select(F.col("conv_id").alias("of"), F.col("call_id").alias("id"), "c", "after", "level"),
                             F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("call_id") == F.col("id")))
    extra_calls = extra_calls.where(F.col("row") != F.col("c.row"))
    extra_results = results.join(pair.where("m > 1").select(F.col("conv_id").alias("of"), F.col("call_id").alias("id"), "r", "after", "level"),
                                 F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("call_id") == F.col("id")))
    extra_results = extra_results.where(F.col("row") != F.col("r.row"))
    more += [message(extra_calls, own, F.col("turn"), "assistant", F.lit("repeated"), F.col("name"), F.col("arguments")),
             message(extra_results, own, F.col("turn"), "tool", F.lit("repeated"), payload=F.col("content"))]
    if others is not None:
        more.append(others.select("conv_id", blank.alias("call_id"), F.col("turn").cast("long").alias("after"), F.lit(0).cast("long").alias("level"),
                                  F.col("turn").cast("long").alias("turn"), "role", F.lit("other").alias("status"), blank.alias("name"),
                                  F.col("content").alias("payload")))
    for one in more:
        messages = messages.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems, texts = [], []
            for call_id, role, status, name, payload in zip(*(
                    batch.column(k).to_pylist() for k in ("call_id", "role", "status", "name", "payload"))):
                if status == "other":
                    problems.append(None)
                    texts.append(canonical({"content": payload, "role": role}))
                    continue
                if role == "tool":
                    problems.append(None)
                    texts.append(canonical({"content": payload, "role": role, "tool_call_id": call_id}))
                    continue
                try:
                    value = None if payload is None else json.loads(payload, parse_constant=lambda c: str(c))
                    found = problem_of(value, schemas[name]) if name in schemas else f"unknown tool {name}"
                except (ValueError, RecursionError):
                    value, found = payload, "$: not JSON"
                problems.append(found)
                texts.append(canonical({"role": role, "tool_calls": [{"arguments": value, "id": call_id, "name": name}]}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("conv_id", "call_id", "after", "level", "turn", "role", "status")), pa.array(problems, pa.string()),
                 pa.array(texts, pa.string())], names=["conv_id", "call_id", "after", "level", "turn", "role", "status", "problem", "json"])

    return messages.mapInArrow(run, MESSAGES)


ASK = {"type": "object", "required": ["question", "words"], "additionalProperties": False, "properties": {
    "question": {"type": "string", "minLength": 1, "maxLength": 200}, "words": {"type": "integer", "minimum": 1, "maximum": 40}}}


def turns_as_calls(turns: DataFrame, chain: int = 1) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool traffic: each user turn calls ``ask`` with its text and number of words, each assistant turn is the
    result of the call one turn earlier. ``other_turns`` has the rest. A call needs the user turn before; with
    ``chain`` over 1 it needs the user turn after, but for every ``chain``-th, so calls wait for later ones."""
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    inside = F.pmod(F.floor(F.col("turn") / 2), F.lit(chain)) < chain - 1
    needs = F.array(name(F.col("turn") - 2)) if chain == 1 else F.when(inside, F.array(name(F.col("turn") + 2))).otherwise(F.array())
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"), F.to_json(F.struct(
            F.col("text").alias("question"), word_count(F.coalesce("text", F.lit(""))).alias("words"))).alias("arguments"),
        needs.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"),
                                                       F.col("text").alias("content"))
    return calls, results


def other_turns(turns: DataFrame) -> DataFrame:
    """The turns that ``turns_as_calls`` leaves: of any other role, or of none."""
    return turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))


_CALLS = r"""
WITH u AS (SELECT conv_id, turn, text, 'c' || conv_id || '_' || turn AS call_id,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
    FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, 'c' || conv_id || '_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
n AS (SELECT DISTINCT conv_id, turn FROM u),
l AS (SELECT n.conv_id, n.turn, {level} AS level FROM n LEFT JOIN n n1 ON n1.conv_id = n.conv_id AND n1.turn = n.turn + 2
    LEFT JOIN n n2 ON n2.conv_id = n.conv_id AND n2.turn = n.turn + 4 LEFT JOIN n n3 ON n3.conv_id = n.conv_id AND n3.turn = n.turn + 6)
SELECT u.conv_id, call_id, u.turn + 2 * level AS after, CAST(level AS BIGINT) AS level, u.turn, 'assistant' AS role,
    CASE WHEN call_id IN (SELECT call_id FROM a) THEN 'linked' ELSE 'no_result' END AS status,
    CASE WHEN length(text) < 1 THEN '$.question: minLength' WHEN length(text) > 200 THEN '$.question: maxLength'
         WHEN words < 1 THEN '$.words: minimum' WHEN words > 40 THEN '$.words: maximum' END AS problem,
    '{{"role":"assistant","tool_calls":[{{"arguments":{{"question":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words
        || '}},"id":"' || call_id || '","name":"ask"}}]}}' AS json
FROM u JOIN l ON l.conv_id = u.conv_id AND l.turn = u.turn
UNION ALL
SELECT a.conv_id, a.call_id, l.turn + 2 * l.level, CAST(l.level AS BIGINT), a.turn, 'tool',
    CASE WHEN l.turn IS NULL THEN 'orphan' ELSE 'linked' END, NULL,
    '{{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || a.call_id || '"}}'
FROM a LEFT JOIN l ON l.conv_id = a.conv_id AND l.turn = a.turn - 1
UNION ALL
SELECT conv_id, NULL, turn, CAST(0 AS BIGINT), turn, role, 'other', NULL,
    '{{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

#: Every row of the table. Calls need earlier ones, so none waits.
SQL = _CALLS.format(level="0")
#: The same with chains of four.
CHAIN_SQL = _CALLS.format(level="""CASE WHEN n1.turn IS NULL OR n.turn // 2 % 4 >= 3 THEN 0
    WHEN n2.turn IS NULL OR n.turn // 2 % 4 >= 2 THEN 1 WHEN n3.turn IS NULL OR n.turn // 2 % 4 >= 1 THEN 2 ELSE 3 END""")
