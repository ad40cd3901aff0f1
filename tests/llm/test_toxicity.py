import random
import zlib

import pytest

from keepsake.llm import toxicity
from keepsake.llm.queries import QUERIES

PLAIN = "the of and river stone table window garden paper letter morning evening walk read write small large".split()
MEAN = "vileword nastyterm foulspeech".split()


def texts(n, toxic, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choices(PLAIN, k=rng.randint(30, 200))
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(MEAN))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(texts(120, True, 1), texts(300, False, 2), 0.2)


def test_unseen_texts_are_told_apart(model):
    score = toxicity.scorer(model)
    toxic, plain = map(score, [" ".join(texts(1, True, 9))]), map(score, texts(50, False, 8))
    assert min(map(score, texts(50, True, 7))) > max(plain) and all(0 <= s <= 1 for s in toxic)


def test_empty_and_very_long_texts(model):
    score = toxicity.scorer(model)
    assert 0 <= score("") < 0.3
    assert 0 <= score("x" * 500_000) <= 1
    assert score(" ".join(texts(300, True, 5))) > 0.5


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "a b", "s"), (2, None, "s"), (None, "c", None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(docs, toxicity.train(docs, labels), ["doc_id", "text"]).collect()
    assert len(found) == 3 and {r["score"] for r in found} == {0.0}
    assert toxicity.score_documents(documents([]), toxicity.fit([], [], 0.0), ["doc_id"]).count() == 0


def test_op9_query_learns_outside_the_held_out_fold(spark, folder_of, documents):
    mean, plain = texts(80, True, 1), texts(200, False, 2)
    rows = [(i, t) for i, t in enumerate(mean + plain)]
    docs = documents([(i, t, "s") for i, t in rows] + [(900, None, None), (901, "", "s"), (901, "", "s")])
    docs = docs.withColumn("score", docs["doc_id"]).withColumn("side", docs["doc_id"])
    for flipped in (False, True):  # labels of the held-out fold don't matter
        labels = spark.createDataFrame(
            [(i, 1, int((i < 80) ^ (flipped and zlib.crc32(str(i).encode()) % 4 == 2))) for i, _ in rows] + [(5, 1, None)],
            "doc_id long, quality int, toxic int")
        found = sorted(map(tuple, QUERIES["op9_compression_toxicity"](
            spark, folder_of(documents=docs, labels=labels)).collect()))
        if flipped:
            assert found == before
        before = found
    assert len(found) == 283
    right = [p == int(i < 80) for i, held, s, p in found if held and i < 280]
    assert sum(right) >= 0.95 * len(right)
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) and p == int(s >= 0.3) for i, held, s, p in found)


def test_sample_is_bounded_before_the_driver_and_by_hash(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, prior: seen.append((toxic, ordinary)))
    rows = [(i, f"text {i} {k}", "s") for i in range(12) for k in range(1 if i else 400)] + [(11, "text 11 0", "s")] * 300
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    collected, collect = [], type(labels).collect
    monkeypatch.setattr(type(labels), "collect", lambda self: collected.append(out := collect(self)) or out)
    toxicity.train(documents(rows), labels, sample_rows=6)
    (toxic, ordinary), = seen
    assert len(toxic) + len(ordinary) == 12 == len(set(toxic + ordinary)) and max(map(len, collected)) <= 12


def test_grams_of_whole_words_and_spans_of_all_texts(monkeypatch):
    counts, _ = toxicity._gram_counts(["x" * 80 + "vileword"])
    assert counts["vileword"] == 1
    used = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples: used.extend(samples) or type("D", (), {"as_bytes": bytes})())
    spans = [str(i).encode() for i in range(120_000)]
    toxicity._trained(spans)
    assert len(used) == len(set(used)) == toxicity.TRAINING_SPANS
    third = len(spans) // 3
    assert all(sum(k * third <= int(s) < (k + 1) * third for s in used) > 10_000 for k in range(3))
