"""Banded signs against the exact comparison of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import retrieval
from keepsake.operators import sign_bands as B
from keepsake.plans import all_queries

DIM = 24


def cloud(n, seed=1, near=0):
    """Random vectors; ``near`` of them have a partner at a similarity of some 0.9."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, DIM))
    m[n - near:] = m[:near] + 0.4 * rng.standard_normal((near, DIM))
    return m.astype(np.float32)


def frame(spark, m, extra=()):
    rows = [(i, [float(x) for x in v], f"2024-01-{1 + i % 5:02d} 10:00:00") for i, v in enumerate(m)]
    df = spark.createDataFrame(rows + list(extra), "id long, embedding array<float>, created_at string")
    return df.withColumn("created_at", F.to_timestamp("created_at"))


def listed(df):
    rows = df.collect()
    out = {(r.id_a, r.id_b): (r.copies_a, r.copies_b, round(r.similarity, 9)) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block,cross_day", [(4096, True), (30, True), (30, False)])
def test_all_found_are_right_and_nearly_all_are_found(spark, monkeypatch, block, cross_day):
    monkeypatch.setattr(B, "BLOCK_ROWS", block)  # 30: buckets are cut into blocks
    m = cloud(600, near=200)
    m[300:340] = m[0] + 0.05 * cloud(40, 9)       # a crowd that shares its buckets
    m[350:360] = m[349]                           # copies
    odd = [(900, None, None), (901, [0.0] * DIM, None), (902, [float("nan")] * DIM, None), (903, [1.0, 2.0], None),
           (904, [1.0, 2.1], "2024-01-02 10:00:00"), (905, [1.0, 2.0], "2024-01-01 10:00:00")]
    df = frame(spark, m, odd)
    exact = listed(retrieval.similar_pairs(df, 0.8, cross_day))
    found = listed(B.near_pairs(df, 0.8, 0.97, cross_day, always=True))
    assert found.items() <= exact.items() and len(found) >= 0.95 * len(exact) > 500
    assert {k for k in exact if k[0] == k[1]} <= set(found)


def test_rows_and_comparisons_grow_below_the_square(spark):
    moved, compared = [], []
    for n in (2_000, 16_000):
        bits, bands = B.band_plan(n, 0.9, 0.95, always=True)
        rows = B.bucket_rows(B.signed(frame(spark, cloud(n, near=100)), bits, bands))
        sizes = rows.groupBy("band", "signs").agg(F.count("*").alias("n"))
        total, squares = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        moved.append(total)
        compared.append(squares / 2)
        assert total <= n * bands
    assert moved[1] < 8 ** 1.5 * moved[0] and compared[1] < 8 ** 1.75 * compared[0]  # the square would be 64
    assert compared[1] < 16_000 ** 2 / 2 / 4


def test_plan_is_the_cheapest_that_reaches_the_recall():
    for n, threshold, recall in ((10_000, 0.9, 0.95), (10_000_000, 0.8, 0.99), (10 ** 9, 0.95, 0.9)):
        bits, bands = B.band_plan(n, threshold, recall)
        agree = 1 - np.arccos(threshold) / np.pi
        assert 1 - (1 - agree ** bits) ** bands >= recall > 1 - (1 - agree ** bits) ** (bands - 1)
    assert B.band_plan(10 ** 9, 0.9, 0.9)[0] > B.band_plan(10 ** 5, 0.9, 0.9)[0]
    assert B.band_plan(100, 0.3, 0.95) is None and B.band_plan(100, -1.0, 0.95, always=True) is None
    assert B.band_plan(100, 1.0, 0.95)[1] == 1


def test_few_vectors_go_to_the_exact_search_and_empty_tables_give_none(spark):
    df = frame(spark, cloud(60, near=20))
    assert listed(B.near_pairs(df, 0.3)) == listed(retrieval.similar_pairs(df, 0.3))
    assert B.near_pairs(df.limit(0), 0.9, always=True).count() == 0
    week = ("2024-01-02", "2024-01-04")
    assert listed(B.near_pairs(df, 0.7, 0.999, True, *week, always=True)) == listed(retrieval.similar_pairs(df, 0.7, True, *week))


def test_vectors_move_to_few_bands_at_a_low_threshold():
    """A comparison inside a bucket is far cheaper than a move, so a plan may not save comparisons by hundreds of bands."""
    bands = [B.band_plan(n, 0.4, 0.99, always=True)[1] for n in (10_256, 102_564, 615_384)]
    assert bands[0] <= 10 and bands[1] <= 60 and bands[2] <= 200
    assert max(n * b for n, b in zip((10_256, 102_564, 615_384), bands)) * 300 < 40e9  # bytes, some 300 a row


def test_vectors_are_written_few_times_at_any_size():
    """At 0.4 the cheapest plan in comparisons took 181 copies of 615,384 vectors; blocks count as copies too."""
    for n in (10_256, 102_564, 615_384):
        assert B.copies_of(n, *B.band_plan(n, 0.4, 0.99, always=True)) <= B.MOST_COPIES
    assert B.copies_of(2_000_000, 4, 27, 64) == 54 and B.copies_of(2_000_000, 4, 27, 1536) == 27 * 46
    assert B.copies_of(20_000_000, *B.band_plan(20_000_000, 0.9, 0.95)) <= B.MOST_COPIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_listed_once_without_a_shuffle_of_them(spark):
    """A pair that meets in several bands comes from the first; days and copies travel with the vectors."""
    df = frame(spark, cloud(400, near=150))
    found = B.near_pairs(df, 0.5, 0.99, always=True)
    above = plan_of(found).split("FlatMapGroupsInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert listed(found).items() <= listed(retrieval.similar_pairs(df, 0.5)).items()  # listed() finds repeated pairs


def test_the_grid_sends_a_vector_to_few_blocks():
    assert [retrieval._pair_blocks_of(n, 64) for n in (0, 8_192, 102_564, 615_384, 2_000_000)] == [1, 1, 13, 16, 31]
    assert retrieval._pair_blocks_of(1_000_000, 1536) == 367


def test_an_id_may_stand_for_several_vectors_or_be_missing(spark, monkeypatch, tmp_path):
    m = cloud(90, near=40)
    m[80:] = m[0] + 0.05 * cloud(10, 5)
    day = "2024-01-{:02d} 10:00:00".format
    rows = [(None if i % 30 == 7 else i % 60, [float(x) for x in v], day(1 + i % 9)) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    ids = [r[0] for r in rows]
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), round(float(unit[i] @ unit[j]), 9)) for i in range(90) for j in range(i)
                  if None not in (ids[i], ids[j]) and ids[i] != ids[j] and unit[i] @ unit[j] > 0.6)
    key = lambda found: sorted((r.id_a, r.id_b, round(r.similarity, 9)) for r in found.collect())
    for block in (4096, 16):  # 16: buckets and the grid are cut into blocks
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
        monkeypatch.setattr(retrieval, "PAIR_ROWS", block)
        assert key(retrieval.similar_pairs(df, 0.6, False)) == want
        assert key(B.near_pairs(df, 0.6, 0.999999, False, always=True)) == want
    table = df.select(F.col("id").alias("vec_id"), "embedding", F.lit(1).alias("label")).where("id IS NOT NULL")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    days = {i: i * 7 % 720 // 24 for i in range(60)}
    pairs = sum(unit[i] @ unit[j] > 0.4 and days[ids[i]] != days[ids[j]] for i in range(90) for j in range(i) if None not in (ids[i], ids[j]))
    row = all_queries()["near_pairs_recall"](spark, str(tmp_path)).first()
    assert (row.pairs, row.wrong, row.reached) == (pairs, 0, True)
    table.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    row = all_queries()["near_pairs_recall"](spark, f"{tmp_path}/none").first()
    assert (row.pairs, row.wrong, row.reached) == (0, 0, True)
