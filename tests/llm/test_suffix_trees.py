import hashlib
import random

import numpy as np
import pytest

from keepsake.llm import suffix_trees
from keepsake.llm.queries import QUERIES


def brute(rows, window=20):
    """rows in order: (doc_id, text)."""
    seen, out = {}, []
    for number, (doc, text) in enumerate(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[p:p + window]), (number, p)) != (number, p):
                gone[p:p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, letters="abcdefgh é漢"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(letters.replace(" ", ""), k=rng.randint(1, 2)))
    make = lambda n: [word() for _ in range(n)]
    shared = [make(rng.randint(18, 90)) for _ in range(6)] + [["a", "b"] * 30, ["x"] * 25]
    rows = []
    for i in range(80):
        parts = [make(rng.randint(0, 40)) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(shared))
        if i % 3 == 0:
            parts.append(rng.choice(shared)[rng.randint(0, 12):])
        rows.append((10 * i, rng.choice([" ", "\n", "  ", "\t"]).join(w for p in parts for w in p)))
    near = rows[7][1].split()
    near[len(near) // 2] = "CHANGED"
    rows += [(801, rows[5][1]), (802, "  " + rows[5][1].replace(" ", "\x0b")), (803, " ".join(near)), (804, None), (805, ""), (806, " \t\n"),
             (807, " ".join("y" * 19)), (808, " ".join("y" * 20)), (809, " ".join("y" * 21)), (810, " ".join(make(9_000))), (811, "z" * 9_000),
             (812, rows[5][1].upper()), (None, rows[9][1] + " tail")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_query_against_brute_force(spark, folder_of, documents, seed):
    rows = corpus(seed, "ab" if seed == 2 else "abcdefgh é漢")
    docs = documents([(i, t, "s") for i, t in rows]).repartition(5)
    docs = docs.withColumn("doc", docs["n_chars"]).withColumn("low", docs["lang"]).withColumn("gram", docs["text"]).withColumn("prefix", docs["lang"])
    found = QUERIES["op11_prefix_suffix_trees"](spark, folder_of(documents=docs)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_longer_prefixes_give_the_same(documents, size):
    docs = documents([(i, t, "s") for i, t in corpus(3, "ab")]).repartition(3)

    def marked(**options):
        return {(r["doc"], p) for r in suffix_trees.repeated_passages(docs, **options).collect() for p in range(r["low"], r["high"] + 1)}
    assert marked(group_size=size) == marked()


def test_nodes_of_a_subtree():
    strings = ["banana", "bandit", "ban", "ba", "can", "candle", "x"]
    words = np.frombuffer("".join(strings).encode(), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(s) for s in strings])
    prefix = np.array([ord(s[0]) for s in strings])
    levels = suffix_trees.subtree(prefix, words, np.cumsum(size) - size, size, 1)
    for depth, level in zip(range(6), levels):
        for i, s in enumerate(strings):
            below = {k for k, t in enumerate(strings) if min(len(s), len(t)) >= depth and s[:max(1, depth)] == t[:max(1, depth)]}
            assert ({k for k in below if level[k] == level[i]} == below) if len(below) > 1 else level[i] == -1


def test_repeated_rows_and_empty_table(documents):
    text = " ".join("w%d" % k for k in range(50))
    found = suffix_trees.remove_passages(documents([(1, text, "s"), (1, text, "s"), (2, text + " more", "s"), (3, text[3:], "s")])).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in found) == [(1, text), (1, text), (2, "more"), (3, "")]
    assert suffix_trees.remove_passages(documents([])).count() == 0
