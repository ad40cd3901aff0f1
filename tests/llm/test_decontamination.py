import itertools
import random

import numpy as np
import pytest

from keepsake.llm import decontamination as D
from keepsake.llm.hashing import word_hashes
from keepsake.llm.queries import QUERIES

VOCABULARY = [f"w{i}" for i in range(3000)]


def text(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def substituted(passage, every, seed):
    words = passage.split()
    for k in range(seed % every, len(words), every):
        words[k] = f"other{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark, documents):
    items = [(i, text(15 + i, 100 + i)) for i in range(20)] + [(20, "alpha beta gamma"), (21, None), (22, ""), (22, "")]
    rows, leaked = [], set()
    for i in range(60):
        body = text(40 + 9 * i, i)
        if i % 3 == 0:
            item = i // 3
            passage = items[item][1] if i % 2 else substituted(items[item][1], 6, i)
            body = f"{body} {passage.upper()}, {text(30, 500 + i)}"
            leaked.add((i, item))
        rows.append((i, body, "s"))
    rows += [(60, "Alpha, beta gamma!", "s"), (61, None, "s"), (62, "", None), (63, "x " * 100_000 + items[5][1], "s"),
             (63, "x " * 100_000 + items[5][1], "s")]
    leaked |= {(60, 20), (63, 5)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return documents(rows), benchmark, leaked


def test_planted_passages_are_found_and_nothing_else(tables):
    docs, benchmark, leaked = tables
    for block_chars in (16_000_000, 900):
        found = D.find_overlaps(docs, benchmark, block_chars=block_chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == leaked
        assert all(r["n_equal"] <= r["n_aligned"] for r in found)


def test_clean_documents_stay_unchanged(tables):
    docs, benchmark, leaked = tables
    docs = docs.withColumn("item_id", docs["doc_id"]).withColumn("n_equal", docs["lang"])
    kept = D.without_overlaps(docs, benchmark)
    assert kept.columns == docs.columns
    gone = {d for d, _ in leaked}
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(63) if i not in gone]


def test_empty_tables(spark, documents, tables):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_overlaps(tables[0], none).count() == 0
    assert D.without_overlaps(tables[0], none).count() == tables[0].count()
    assert D.find_overlaps(documents([]), tables[1]).count() == 0


def test_word_hashes_follow_the_words():
    texts = ["A b, c", "", "...", "b\tC a", "é è É"]
    hashes, bounds = word_hashes(texts)
    assert np.diff(bounds).tolist() == [3, 0, 0, 3, 3]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[3] and hashes[6] == hashes[8] != hashes[7]


def test_op5_query(folder_of, tables, spark):
    docs, benchmark, leaked = tables
    found = QUERIES["op5_spaced_seeds"](spark, folder_of(documents=docs, benchmark=benchmark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaked


def test_short_items_are_found_with_words_changed_anywhere():
    """Items of 4 to 12 words: what four fifths allow to differ, at every place; one more doesn't count."""
    for n in range(4, 13):
        words = [f"v{k}" for k in range(n)]
        index = D.build_index([(n, " ".join(words))], 10, 1.0)
        spare = int(n - np.ceil(0.8 * n))
        for out in [(), *((k,) for k in range(n)), *itertools.combinations(range(n), 2)]:
            passage = " ".join("other" if k in out else w for k, w in enumerate(words))
            equal = np.array([k not in out for k in range(n)])
            start, end = D._best_run(equal, 1.0)
            counts = equal[start:end].sum() >= 0.8 * n
            assert counts == (len(out) <= spare) or len(out) == 2
            for text in (passage, f"some words before {passage} and after it"):
                assert bool(list(D.overlaps([text], index))) == counts, (n, out)
        for text in (" ".join(words[1:]), " ".join(words[:-1])):  # the other word is not even there
            assert bool(list(D.overlaps([text], index))) == (spare > 0)


def test_best_run_is_that_of_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(0, 14))], dtype=bool)
        start, end = D._best_run(equal, 1.0)
        value = lambda a, b: (2 * int(equal[a:b].sum()) - (b - a), int(equal[a:b].sum()))
        assert value(start, end) == max(value(a, b) for a in range(len(equal) + 1) for b in range(a, len(equal) + 1))
