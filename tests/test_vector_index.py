"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import retrieval as R
from keepsake.operators import vector_index as V

N, DIM = 3000, 18


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, DIM))
    m = centres[rng.integers(0, 40, N)] + 0.35 * rng.standard_normal((N, DIM))
    m[7] = m[8] = m[9]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(N, None), (N + 1, [0.0] * DIM), (N + 2, [float("nan")] * DIM), (N + 3, []), (N + 4, [1.0, 2.0]), (N + 5, [1.0, 2.1]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return V.build_index(vectors, str(tmp_path_factory.mktemp("index")))


def test_recall_and_what_is_read(spark, vectors, index):
    asked = vectors.where(f"id < 100 and size(embedding) = {DIM}").distinct()
    exact = R.match_many(asked, vectors, threshold=-2, k=10)
    found = V.match_many_indexed(index, asked, k=10, threshold=-2)
    hits = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    assert hits >= 0.9 * exact.count()
    assert index.probes < len(index.centres) / 2  # clustered vectors need few lists
    one = V.match_indexed(spark, index, [1.0] * DIM, k=5, threshold=-2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("list" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert any("embedding" not in s.split("ReadSchema")[1] for s in scans)  # codes are scored without their vectors


def test_reading_all_lists_is_exact(spark, vectors, index):
    asked = [float(x) for x in vectors.where("id = 9").first().embedding]
    exact = R.match_many(spark.createDataFrame([(0, asked)], "id long, embedding array<float>"), vectors, threshold=0.3, k=12)
    found = V.match_indexed(spark, index, asked, k=12, threshold=0.3, probes=V.MAX_LISTS, candidates=10 * N).collect()
    expected = exact.orderBy("rank").collect()
    assert [round(r.similarity, 9) for r in found] == [round(r.similarity, 9) for r in expected]
    assert {7, 8, 9} <= {r.id for r in found} and sum(r.id == 7 for r in found) == 2
    many = V.match_many_indexed(index, vectors.where("id = 9"), k=12, threshold=0.3, probes=V.MAX_LISTS, candidates=10 * N)
    assert [round(r.similarity, 9) for r in many.orderBy("rank").collect()] == [round(r.similarity, 9) for r in expected]


def test_every_usable_vector_is_stored_once_per_row(spark, vectors, index):
    stored = index.rows(spark)
    assert stored.count() == N + 3 and stored.where("list = -1").count() == 2
    assert [r.id for r in V.match_indexed(spark, index, [1.0, 2.0], threshold=0.5).collect()] == [N + 4, N + 5]
    assert V.match_indexed(spark, index, [0.0] * DIM).count() == 0


def test_divided_lists_give_the_same(spark, vectors, index, monkeypatch):
    asked = vectors.where("id between 20 and 40")
    found = lambda: sorted(map(tuple, V.match_many_indexed(index, asked, k=6, threshold=0.1).collect()))
    whole = found()
    monkeypatch.setattr(V, "PART_ROWS", 10)
    assert found() == whole


def test_opened_again_and_empty(spark, vectors, index, tmp_path):
    again = V.open_index(spark, index.path)
    q = [float(k) for k in range(DIM)]
    assert V.match_indexed(spark, again, q, threshold=-2).collect() == V.match_indexed(spark, index, q, threshold=-2).collect()
    empty = V.build_index(vectors.where("id < 0"), str(tmp_path / "none"))
    assert V.match_indexed(spark, empty, [1.0]).count() == 0
    assert V.match_many_indexed(empty, vectors.where(F.lit(False))).count() == 0


def test_recall_over_rows_that_were_not_trained_on(spark, tmp_path):
    m = np.random.default_rng(3).standard_normal((6000, DIM))
    m[:800] = m[0]  # copies: their neighbours are the smallest ids
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").cache()
    index = V.build_index(rows, str(tmp_path / "index"), sample_rows=600)
    asked = rows.where("id < 5 or id >= 5900")
    found = V.match_many_indexed(index, asked, k=10, threshold=-2)
    exact = R.match_many(asked, rows, threshold=-2, k=10)
    hits = {(r.query_id, r.id) for r in found.collect()} & {(r.query_id, r.id) for r in exact.collect()}
    assert len(hits) >= 0.9 * 105 * 10
    assert [r.id for r in found.where("query_id = 3").orderBy("rank").collect()] == list(range(10))
    assert V.open_index(spark, index.path).candidates(10) == index.candidates(10) >= 200
