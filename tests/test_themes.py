"""Bisected themes: planted clusters, any partitioning, odd rows."""

import numpy as np

from keepsake.operators.themes import bisected_themes, theme_labels

DIM = 12


def rows_of(n=240, groups=4):
    rng = np.random.default_rng(2)
    centres = np.eye(DIM)[:groups] * 4
    return [(i, [float(x) for x in (centres[i % groups] + 0.5 * rng.standard_normal(DIM)) * rng.uniform(0.1, 9)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.theme, set()).add(r.id)
    return out


def test_planted_clusters_under_any_partitioning(spark):
    df = frame(spark, rows_of())
    found = groups_of(bisected_themes(df.repartition(1), 4))
    assert sorted(map(sorted, found.values())) == [list(range(k, 240, 4)) for k in range(4)]
    assert groups_of(bisected_themes(df.repartition(7, "embedding"), 4)) == found
    topics = spark.createDataFrame([(i, f"t{i % 4}") for i in range(240)] + [(i, "often") for i in range(0, 240, 9)] + [(1, None)], "id long, topic string")
    labels = {r.theme: (r.topic, r.thoughts) for r in theme_labels(bisected_themes(df, 4), topics).collect()}
    assert labels == {theme: (f"t{min(ids)}", 60) for theme, ids in found.items()}


def test_odd_rows(spark):
    alike = [(i, [1.0, 2.0]) for i in range(5)]
    odd = [(10, None), (11, [0.0, 0.0]), (12, [float("nan"), 1.0]), (13, [1.0, 2.0, 3.0]), (0, [2.0, 4.0])]
    assert groups_of(bisected_themes(frame(spark, alike + odd), 3)) == {0: {0, 1, 2, 3, 4}}
    found = groups_of(bisected_themes(frame(spark, alike + odd + [(20, [-1.0, 1.0])]), 3))
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3, 4], [20]]
    assert bisected_themes(frame(spark, []), 3).count() == 0
