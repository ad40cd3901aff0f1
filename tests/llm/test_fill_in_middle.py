import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsake.llm import fill_in_middle
from keepsake.llm.queries import QUERIES
from test_llm_queries import against_sql

ODD = ["", None, " ", "\n", "a", "é", "漢🙂", "🙂" * 130, "line one\r\nline two\n", "$1 \\1 {2} (.*+) [x] ^$", "<P> in it", "x<S>", "<M", "a<", "<<P", "S>",
       " \x85 \0 odd", "é" * 70, "x" * 63, "y" * 64, "z" * 65, "long 🙂 text\n" * 40_000]


def brute(doc_id, text, plain=10, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_op12_query_on_odd_rows(spark, folder_of, documents):
    rows = [(100 * k + i, t, None) for i, t in enumerate(ODD) for k in range(12)] + [(None, "no id", "s"), (-5, "below zero", "s"), (7, "twice", "s"), (7, "twice", "s")]
    docs = documents(rows)
    for name in ("n", "h1", "form", "first", "output"):
        docs = docs.withColumn(name, docs["lang"])
    folder = folder_of(documents=docs)
    against_sql(spark, folder, "op12_counted_fim")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = {tuple(r) for r in QUERIES["op12_counted_fim"](spark, folder).collect()}
    assert found == {(*r[:5], sha(r[5]), sha(t or "")) for i, t, _ in rows for r in [brute(i, t)]}
    made = fill_in_middle.fill_in_middle(docs)
    assert {tuple(r) for r in made.collect()} == {brute(i, t) for i, t, _ in rows}
    assert fill_in_middle.fill_in_middle(documents([])).count() == 0


def test_other_shares(documents):
    rows = [(i, f"text {i}", "s") for i in range(60)]
    made = fill_in_middle.fill_in_middle(documents(rows), plain_percent=0, spm_percent=100).collect()
    assert {tuple(r) for r in made} == {brute(i, t, 0, 100) for i, t, _ in rows} and {r["form"] for r in made} == {"spm"}


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="<PSM>a🙂\n", max_size=14), min_size=1, max_size=40))
def test_round_trip(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(docs, plain_percent=0, spm_percent=50)
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == dict(enumerate(texts))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 1000])
def test_units(evaluate, n):
    assert evaluate(fill_in_middle.count_units(F.lit("🙂" * n))) == n


def test_nothing_is_shuffled_and_no_python(documents):
    made = fill_in_middle.fill_in_middle(documents([(1, "text", "s")]))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Arrow", "Python", "Window"))
