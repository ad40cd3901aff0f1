import random
import re

import pytest

from keepsake.llm.components import connected_components
from keepsake.llm.queries import QUERIES


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_op7_query_against_brute_force(spark, folder_of, documents, seed):
    rng = random.Random(seed)
    rows, base = [], [rng.choices([f"w{i}" for i in range(400)], k=rng.randint(20, 120)) for _ in range(12)]
    for i in range(260):
        words = edited(base[i % 12], rng, rng.choice([0, 1, 1, 2, 3, 5])) if i % 3 else rng.choices([f"w{i}" for i in range(400)], k=60)
        if i % 5 == 0:
            words = words + base[0][:15]
        rows.append((1000 - i, " ".join(words)))
    chain = rng.choices([f"c{i}" for i in range(300)], k=150)
    for i in range(25):  # each links to the next, the ends don't
        chain = edited(chain, rng, 2)
        rows.append((2000 + i, " ".join(chain)))
    rows += [(1, "a b"), (2, "A  B"), (3, ""), (4, None), (5, " \t"), (6, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"),
             (8, "É x y z w"), (9, "é x y z w"), (10, "l " * 50_000), (11, " ".join(f"q{k}" for k in range(20_000)))]
    docs = documents([(i, t, "s") for i, t in rows]).repartition(6)
    for name in ("size", "sid", "gram"):
        docs = docs.withColumn(name, docs["lang"])
    found = QUERIES["op7_vertical_jaccard"](spark, folder_of(documents=docs)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_empty_and_single(spark, folder_of, documents):
    assert QUERIES["op7_vertical_jaccard"](spark, folder_of(documents=documents([]))).count() == 0
    one = QUERIES["op7_vertical_jaccard"](spark, folder_of(documents=documents([(5, "a b c d e", "s")]))).collect()
    assert [tuple(r) for r in one] == [(5, 2, 5)]


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1000)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(path).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
