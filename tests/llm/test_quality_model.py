import random

import numpy as np
import pytest

from keepsake.llm import quality_model as Q
from keepsake.llm.queries import QUERIES

WORDS = "river stone table window garden paper letter morning evening walking reading written small large".split()


def clean(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + f"{rng.choice('abcdefgh')}{rng.choice('klmno')}" + rng.choice([""] * 8 + [".", ","])
                    for _ in range(rng.randint(60, 200)))


def junk(seed):
    words = clean(seed).split()
    return [" ".join(w + "***" for w in words), " ".join(w.upper() + "!!" for w in words), " | ".join(words),
            " ".join(w for w in words for _ in range(12))][seed % 4]


def test_reliabilities_of_simulated_labellers_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.75, 0.9, 0.65])
    right = rng.random((20_000, 5)) < accuracy
    votes = np.where(rng.random((20_000, 5)) < 0.2, Q.SILENT, np.where(right, truth[:, None], ~truth[:, None]).astype(int))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = Q.expectation_maximisation(patterns, counts.astype(float))
    estimated = found.table[:, 1, 1]
    assert estimated == pytest.approx(accuracy, abs=0.05)
    assert found.prior == pytest.approx(0.7, abs=0.05)


def test_op10_query_keeps_clean_and_rejects_junk(spark, folder_of, documents):
    rows = [(i, junk(i) if i % 5 == 0 else clean(i), "s") for i in range(400)]
    rows += [(400, None, "s"), (401, "", None), (401, "", None), (402, clean(1) * 200, "s"), (None, clean(2), "s")]
    docs = documents(rows)
    docs = docs.withColumn("score", docs["doc_id"]).withColumn("kept", docs["text"])
    found = QUERIES["op10_weak_label_quality"](spark, folder_of(documents=docs)).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] == (i % 5 != 0) for i in range(400))
    assert not kept[400] and not kept[401] and kept[402] and kept[None]
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in found)


def test_empty_table(documents):
    assert Q.score_quality(documents([])).count() == 0


def test_long_words_count_whole():
    def x(word):
        return Q.hashed([word], Q.Counter([word]))
    same, other = "a" * 50 + "end", "a" * 45 + "###aaend"
    assert Q._shape(same) == "a" and Q._shape(other) == "a#a" and Q._shape("a" * 40 + "A0") == "aA0"
    assert (x(same) == x("a" * 2000 + "end")).all() and (x(same) != x(other)).any()


def test_sample_takes_copies_once_and_is_bounded(documents, monkeypatch):
    sizes = []
    monkeypatch.setattr(Q, "train_scorer", lambda x, target: sizes.append(len(x)))
    Q.fit(documents([(1, clean(1), "s")] * 500 + [(i, clean(i), "s") for i in range(2, 60)]))
    Q.fit(documents([(i, clean(i), "s") for i in range(300)]), sample_rows=40)
    assert sizes == [59, 40]


def test_copies_of_one_text_leave_room_in_the_sample(spark, documents, monkeypatch):
    sizes = []
    monkeypatch.setattr(Q, "train_scorer", lambda x, target: sizes.append(len(x)))
    copies = spark.range(200_000).selectExpr("id as doc_id", "'one and the same text' as text", "'en' lang", "'s' source", "1L n_chars")
    Q.fit(copies.unionByName(documents([(k, f"short text number {k}", "s") for k in range(700)])), sample_rows=600)
    assert sizes == [600]
