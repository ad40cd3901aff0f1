"""Vector search against brute force, on both the broadcast and the block-grid path."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import retrieval as R

N, DIM = 60, 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    m = rng.standard_normal((N, DIM)).astype(np.float32)
    m[10], m[11], m[12] = m[3], m[3], m[4]           # exact copies
    return m


@pytest.fixture(scope="module")
def thoughts(spark, data):
    rows = [(i, f"text {i}", '{"source":"%s"}' % ("a" if i < 30 else "b"), [float(x) for x in v], f"2024-01-{1 + i // 12:02d} 10:00:00")
            for i, v in enumerate(data)]
    rows += [(100, "no vector", "{}", None, "2024-01-01 10:00:00"), (101, "zero", "{}", [0.0] * DIM, "2024-01-01 10:00:00")]
    return spark.createDataFrame(rows, "id long, content string, metadata string, embedding array<float>, created_at string") \
                .withColumn("created_at", F.to_timestamp("created_at")).cache()


@pytest.fixture(scope="module")
def sims(data):
    u = data.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T


@pytest.fixture(params=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(R, "BLOCK_ROWS", 7)
        monkeypatch.setattr(R, "BROADCAST_BYTES", 600)
        monkeypatch.setattr(R, "_TILE", 3)
    return request.param


def ranked(row, threshold, k, skip=()):
    order = sorted((i for i in range(N) if row[i] > threshold and i not in skip), key=lambda i: (-round(row[i], 12), i))
    return order[:k]


def test_other_widths_and_unusable_vectors_have_no_similarity(spark, blocks):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]),
            (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, None), (8, [])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "id long, embedding array<float>, created_at timestamp")
    found = {(r.query_id, r.id) for r in R.match_many(df, df, threshold=0.5, k=9).collect()}
    assert found == {(a, b) for pair in ((1, 2), (3, 4)) for a in pair for b in pair}
    pairs = R.similar_pairs(df, threshold=0.5, cross_day=False).collect()
    assert {(r.id_a, r.id_b) for r in pairs} == {(1, 2), (3, 4)}
    assert R.similar_pairs(df, threshold=0.5).count() == 0  # no dates, so no different days
    assert {r.id for r in R.novelty(df, n=None).collect()} == {1, 2, 3, 4}


def test_match_thoughts(thoughts, data, sims):
    query = [float(x) for x in data[3]]
    found = R.match_thoughts(thoughts, query, threshold=0.2, k=6).collect()
    assert [r.id for r in found] == ranked(sims[3], 0.2, 6)
    assert found[0].similarity == pytest.approx(1.0) and found[0].content == "text 3"
    assert R.match_thoughts(thoughts, query, threshold=-2, k=500).count() == N
    only_b = R.match_thoughts(thoughts, query, threshold=0.0, k=5, filter={"source": "b"}).collect()
    assert [r.id for r in only_b] == ranked(sims[3], 0.0, 5, skip=range(30))


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, "a", "{}", [0.0, 2.0], None)], "id int, content string, metadata string, embedding array<float>, created_at timestamp")
    assert R.match_thoughts(df, [0.0, 1.0], threshold=1.0).count() == 0
    assert R.match_thoughts(df, [0.0, 1.0], threshold=0.999).count() == 1


def test_match_many(blocks, thoughts, sims):
    queries = thoughts.where("id < 20 or id >= 100").select("id", "embedding")
    found = R.match_many(queries, thoughts, threshold=0.1, k=4).orderBy("query_id", "rank").collect()
    expected = [(q, i, n + 1) for q in range(20) for n, i in enumerate(ranked(sims[q], 0.1, 4))]
    assert [(r.query_id, r.id, r["rank"]) for r in found] == expected


def test_match_many_without_queries(spark, thoughts):
    none = thoughts.where("id < 0").select("id", "embedding")
    assert R.match_many(none, thoughts).count() == 0


@pytest.mark.parametrize("cross_day", [True, False])
def test_similar_pairs(blocks, thoughts, sims, cross_day):
    copies = {3: [3, 10, 11], 4: [4, 12]}
    members = {i: copies.get(i, [i]) for i in range(N) if i not in (10, 11, 12)}
    day = lambda i: i // 12
    expected = set()
    for a in members:
        for b in members:
            apart = not cross_day or len({day(x) for x in members[a] + members[b]}) > 1
            if a < b and sims[a, b] > 0.4 and apart:
                expected.add((a, b, len(members[a]), len(members[b])))
        if len(members[a]) > 1 and (not cross_day or len({day(x) for x in members[a]}) > 1):
            expected.add((a, a, len(members[a]), len(members[a])))
    found = R.similar_pairs(thoughts, 0.4, cross_day).collect()
    assert {(r.id_a, r.id_b, r.copies_a, r.copies_b) for r in found} == expected and len(found) == len(expected)
    for r in found:
        assert r.similarity == pytest.approx(sims[r.id_a, r.id_b])


def test_copies_expand_to_all_pairs(thoughts):
    listed = {r.id: r.representative for r in R.vector_copies(thoughts).collect()}
    assert (listed[10], listed[11], listed[12], listed[5]) == (3, 3, 4, 5) and len(listed) == N


def test_novelty(blocks, thoughts, sims):
    off = sims - 10 * np.eye(N)
    found = {r.id: r.novelty for r in R.novelty(thoughts, n=None).collect()}
    assert found == pytest.approx({i: 1 - off[i].max() for i in range(N)})
    top = R.novelty(thoughts, "2024-01-02", "2024-01-04", n=3).collect()
    window = list(range(12, 36))
    expected = sorted(window, key=lambda i: (-(1 - max(sims[i, j] for j in window if j != i)), i))[:3]
    assert [r.id for r in top] == expected


def test_lonely_thought_is_novel(thoughts):
    assert R.novelty(thoughts.where("id = 5"), n=1).first().novelty == 1.0


def test_match_documents(spark, thoughts, data, sims):
    chunks = thoughts.select(F.floor(F.col("id") / 5).alias("doc_id"), F.pmod("id", F.lit(5)).alias("position"), "embedding")
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de") for i in range(12)], "id long, lang string")
    found = R.match_documents(docs, chunks, [float(x) for x in data[3]], F.col("lang") == "en", threshold=0.0, k=4).collect()
    best = {d: max(range(5 * d, 5 * d + 5), key=lambda i: (sims[3, i], -i)) for d in range(1, 12, 2)}
    order = sorted((d for d in best if sims[3, best[d]] > 0), key=lambda d: -sims[3, best[d]])[:4]
    assert [(r.doc_id, r.position) for r in found] == [(d, best[d] % 5) for d in order]


def test_queries_of_more_than_a_block_meet_on_the_grid(spark, thoughts, sims, monkeypatch):
    queries = thoughts.where("id < 20").select("id", "embedding")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow local" in plan(R.match_many(queries, thoughts, threshold=0.1, k=4))
    monkeypatch.setattr(R, "BLOCK_ROWS", 19)  # 20 queries are no longer held by every task
    found = R.match_many(queries, thoughts, threshold=0.1, k=4)
    assert "FlatMapGroupsInArrow" in plan(found) and "MapInArrow local" not in plan(found)
    rows = [(r.query_id, r.id, r["rank"]) for r in found.orderBy("query_id", "rank").collect()]
    assert rows == [(q, i, n + 1) for q in range(20) for n, i in enumerate(ranked(sims[q], 0.1, 4))]


def test_memory_of_a_block_pair(spark, monkeypatch):
    """Two whole blocks are compared in tiles: two tiles of 8 MB at a time at most, whatever the number of rows."""
    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    x, ids = np.random.default_rng(1).standard_normal((R.BLOCK_ROWS, 4)), np.arange(R.BLOCK_ROWS)
    (across, down), most = peak(lambda: R._highest(x, x, ids, ids, True))
    assert most < 20 * 2 ** 20 and across == pytest.approx(down)
    assert across[7] == pytest.approx(np.delete(x[7] @ x.T, 7).max())
    best, most = peak(lambda: R._best(x, ids, x, ids, 0.0, 2))
    assert most < 80 * 2 ** 20 and len(best) == 2 * len(ids)
