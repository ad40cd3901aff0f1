"""The queries that SQL can express, against DuckDB; and what every query must not do."""

import os

import duckdb
import pytest

from keepsake.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "conversations")


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder.removeprefix('file://')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    answer = con.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    found = QUERIES[name](spark, folder)
    assert set(found.columns) == set(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(answer.fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    against_sql(spark, FOLDER, name)


def test_line_rules_on_odd_rows(spark, folder_of, documents):
    common = "Share this page  with 12 friends"
    rows = [(i, f"{common.replace('12', str(i))}\nown text of {chr(97 + i % 26) * (i + 1)} " + "e f g h i j k l m n o p q r", "h") for i in range(40)]
    rows += [(100 + i, f"{common}\n{common.upper()}\nfew words here only {i}", "h") for i in range(3)]
    rows += [(200, None, "h"), (201, "", None), (202, " \t\n", "h"), (203, "a b c d e " * 5, "h"), (203, "a b c d e " * 5, "h"),
             (204, "é 漢字 🙂 " + "w1 w2 w3 w4 w5 w6 x w1 w2 w3 w4 w5 w6 #*|<\n\nx\nx\ny\r\nx", None), (None, "k " * 9, "h"),
             (205, " ".join(f"z{k % 50_000}" for k in range(120_000)), "h")]
    docs = documents(rows)
    for name in ("line", "host", "lines", "gone", "n_words"):
        docs = docs.withColumn(name, docs["lang"])
    folder = folder_of(documents=docs)
    against_sql(spark, folder, "op2_line_frequency")
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op2_line_frequency"](spark, folder).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(3))
    assert not kept[200] and not kept[203]


def test_line_rules_give_the_clean_text(documents):
    from keepsake.llm import line_rules
    docs = documents([(i, f"menu home about\nbody {i} one two three four five six seven eight", "h") for i in range(25)])
    found = line_rules.apply_line_rules(docs).collect()
    assert {r["clean_text"] for r in found} == {f"body {i} one two three four five six seven eight" for i in range(25)}
    assert line_rules.apply_line_rules(documents([])).count() == 0
