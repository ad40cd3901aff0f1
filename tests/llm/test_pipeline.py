import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keepsake.session import fresh_path

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll", "m")]


def text(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def tables(spark, documents):
    rng = random.Random(0)
    rows = [(i, text(rng.randint(40, 120), i), f"s{i % 3}") for i in range(240)]
    toxic = set(range(0, 240, 6))
    for i in toxic:
        words = rows[i][1].split()
        for _ in range(6):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm"]))
        rows[i] = (i, " ".join(words), rows[i][2])
    copies = {}
    for k, i in enumerate((1, 2, 3, 4, 5)):  # exact and near copies
        words = rows[i][1].split()
        if k % 2:
            words[3] = "changed"
        rows.append((300 + k, " ".join(words), "s1"))
        copies[300 + k] = i
    items = [(k, text(30, 900 + k)) for k in range(5)]
    leaked = {400 + k for k in range(5)}
    rows += [(400 + k, text(30, 700 + k) + " " + items[k][1], "s2") for k in range(5)]
    rows += [(500, None, "s0"), (501, "", None), (502, rows[7][1] + " tail", None), (7, rows[7][1], "s1")]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int")
    return {"documents": documents(rows), "labels": labels, "benchmark": spark.createDataFrame(items, "item_id long, text string")}, toxic, copies, leaked


def test_stages_take_effect(spark, folder_of, tables):
    tables, toxic, copies, leaked = tables
    folder = folder_of(**tables)
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        found, was = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in before.collect())
        if name == "toxicity":
            gone = set(was) - set(found)
            assert gone <= toxic and len(gone) >= 0.9 * len(toxic)
        elif name == "near_duplicates":
            assert set(was) - set(found) == set(copies) | {502} and found[7] == 1
        elif name == "decontamination":
            assert set(was) - set(found) == leaked
        elif name == "mixing":
            assert set(found) < set(was) and max(found.values()) <= 3
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        else:
            assert found == Counter(i for i, _ in texts)
            tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
            expected = []
            for i, t in sorted(texts, key=lambda r: r[0]):
                ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
                expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
                start += len(ids)
            assert sorted(map(tuple, docs.collect())) == expected
        if name != "token_files":
            assert docs.columns == before.columns
        sizes.append(docs.count())
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]


def test_pipeline_of_empty_tables(spark, folder_of, tables):
    assert corpus_pipeline.run(spark, folder_of(**{k: df.limit(0) for k, df in tables[0].items()})).count() == 0


def test_what_op9_marks_is_dropped(spark, folder_of, tables, monkeypatch):
    folder = folder_of(**tables[0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for score, kept in ((0.31, 0), (0.29, docs.count())):
        monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *_, **__: corpus_pipeline.toxicity.Model(b"", b"", None, score))
        assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == kept
