import hashlib
import random

import pytest

from keepsake.llm import repeats
from keepsake.llm.queries import QUERIES
from keepsake.llm.suffix_order import common_prefix, deep_shallow


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(256)), b"\0\xff"])
def test_order_and_common_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    stem = bytes(rng.choices(alphabet, k=120))
    strings = [stem[:rng.randint(0, 100)] + bytes(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(400)]
    strings += [b"", b"", stem, stem[:16], stem[:8], b"\0" * 20, b"\0" * 16]
    order, shared = deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert shared == [-1, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def brute(rows, length=100):
    """rows in order: (doc_id, text)."""
    seen, out = {}, []
    for number, (doc, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p:p + length], (number, p)) != (number, p):
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdefgh é漢", k=n))
    shared = [make(rng.randint(90, 400)) for _ in range(6)] + ["ab" * 150, "x" * 130]
    rows = []
    for i in range(70):
        parts = [make(rng.randint(0, 150)) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(shared))
        if i % 3 == 0:
            parts.append(rng.choice(shared)[rng.randint(0, 60):])
        rows.append((10 * i, "".join(parts)))
    rows += [(701, rows[5][1]), (702, rows[5][1]), (703, rows[8][1][:50] + "!" + rows[8][1][50:]), (704, None), (705, ""),
             (706, "y" * 99), (707, "y" * 100), (708, "y" * 101), (709, make(30_000)), (None, rows[9][1] + "tail")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op3_query_against_brute_force(spark, folder_of, documents, seed, monkeypatch):
    rows = corpus(seed)
    docs = documents([(i, t, "s") for i, t in rows]).repartition(5)
    docs = docs.withColumn("doc", docs["n_chars"]).withColumn("low", docs["lang"]).withColumn("gram", docs["text"])
    found = QUERIES["op3_deep_shallow"](spark, folder_of(documents=docs)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


def test_hot_grams_give_the_same(documents):
    docs = documents([(i, t, "s") for i, t in corpus(3)])
    def marked(**options):
        return {(r["doc"], p) for r in repeats.repeated_windows(docs, **options).collect() for p in range(r["low"], r["high"] + 1)}
    assert marked(hot_group=3) == marked()


def test_repeated_rows_and_empty_table(documents):
    text = "some text " * 5 + "".join(random.Random(1).choices("abcdef", k=300))
    found = repeats.remove_repeats(documents([(1, text, "s"), (1, text, "s"), (2, text, "s")])).collect()
    assert sorted((r["doc_id"], len(r["kept_bytes"])) for r in found) == [(1, 350), (1, 350), (2, 0)]
    assert repeats.remove_repeats(documents([])).count() == 0
