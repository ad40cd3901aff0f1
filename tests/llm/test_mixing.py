import numpy as np
import pytest

from keepsake.llm import mixing
from keepsake.llm.queries import QUERIES


def level_targets(sizes, weights, cap):
    """Share again and again until no target is above its cap."""
    total = sum(sizes.values())
    fixed, open_ = {}, dict(weights)
    while True:
        left = total - sum(fixed.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        above = [s for s in share if share[s] > cap * sizes[s]]
        if not above:
            return {**fixed, **share}
        for s in above:
            fixed[s] = cap * sizes[s]
            del open_[s]


def test_targets_are_the_fixed_point_of_sharing_again(spark):
    sizes = {"a": 1000, "b": 5, "c": 40, "d": 0, "e": 700, "f": 90}
    weights = {s: w for s, w in zip(sizes, (1, 2, 3, 1, 2, 3))}
    found = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    expected = level_targets(sizes, weights, 3)
    assert found == pytest.approx(expected)
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("seed", range(5))
def test_pairing_keeps_the_sum_and_leaves_one_between(seed):
    rng = np.random.default_rng(seed)
    full = rng.integers(1, 500, 300).astype(float)
    mass = full * 0.37
    out = mixing.pair_off(mass, full, rng.random(300))
    assert out.sum() == pytest.approx(mass.sum())
    assert ((out > 1e-6) & (out < full - 1e-6)).sum() <= 1


def test_pairing_keeps_each_expectation():
    full, rng = np.array([10.0, 3.0, 7.0, 200.0]), np.random.default_rng(1)
    mean = np.mean([mixing.pair_off(full * 0.3, full, rng.random(4)) for _ in range(4000)], axis=0)
    assert mean == pytest.approx(full * 0.3, rel=0.1)


def test_mix_over_a_tree_of_buckets(spark, documents):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{i % 5}" if i % 3 else "hot") for i in range(900)]
    rows += [(901, None, "s1"), (902, "a b", None), (902, "a b", None), (None, "c d", "s1"), (903, "x " * 4000, "s2")]
    docs = documents(rows)
    options = dict(bucket_units=20, fan_in=3)
    found = mixing.mix_sources(docs, **options).collect()
    assert len(found) == len(rows)
    assert sorted(map(tuple, found), key=str) == sorted(
        map(tuple, mixing.mix_sources(docs.repartition(7), **options).collect()), key=str)
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        share = own[0]["target"] / own[0]["source_size"]
        assert all(int(share) <= r["copies"] <= int(share) + 1 and r["copies"] <= 3 for r in own)
    taken = mixing.mixed_documents(docs, **options)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r["copies"] for r in found)


def test_mix_of_an_empty_table_and_clashing_columns(spark, documents):
    assert mixing.mix_sources(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0
    clash = documents([(1, "a b c", "s"), (2, "d", "t")])
    for name in ("size", "target", "copies", "mass", "node", "row"):
        clash = clash.withColumn(name, clash["doc_id"])
    assert mixing.mix_sources(clash).count() == 2
    assert mixing.mixed_documents(clash).columns == clash.columns


def test_op6_query(spark, folder_of, documents):
    folder = folder_of(documents=documents([(i, "w " * (i % 9), f"s{i % 2}") for i in range(50)]))
    found = QUERIES["op6_pivotal_mix"](spark, folder).collect()
    assert {r["doc_id"] for r in found} == set(range(50))
    assert all(r["taken"] <= 3 * r["size"] for r in found)


def test_many_equal_rows_give_what_is_asked(documents):
    rows = [(1, "ten words " * 5, "a")] * 1000 + [(k, "other words here", "b") for k in range(2, 2002)]
    docs = documents(rows).repartition(6)
    found = mixing.mix_sources(docs).collect()
    own = [r for r in found if r["doc_id"] == 1]
    assert len(own) == 1000 and {r["copies"] for r in own} <= {int(own[0]["target"] / 10_000), int(own[0]["target"] / 10_000) + 1}
    assert abs(sum(10 * r["copies"] for r in own) - own[0]["target"]) <= 10
    taken = mixing.mixed_documents(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in taken} == {
        s: sum(r["copies"] for r in found if r["source"] == s) for s in ("a", "b")}


def test_rows_alike_but_for_other_columns(documents, spark):
    rows = [(1, "w " * 10, "en", "a", 20)] * 3 + [(1, "w " * 10, "de", "a", 20)] * 4 + [(2, "x " * 35, "en", "b", 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = sum(r["copies"] for r in mixing.mix_sources(docs).collect() if r["doc_id"] == 1)
    found = [mixing.mixed_documents(docs.repartition(n)).where("doc_id = 1").groupBy("lang").count().orderBy("lang").collect() for n in (1, 4)]
    assert found[0] == found[1] and sum(r["count"] for r in found[0]) == copies
