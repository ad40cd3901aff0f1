import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st

from keepsake.llm import token_alignment
from keepsake.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def cuts(ends_a, ends_b):
    """Groups of tokens between shared ends, by a set of them."""
    shared = [0, *sorted(set(ends_a) & set(ends_b))]
    tokens = lambda ends, low, high: [k for k, e in enumerate(ends) if low < e <= high]
    return [(tokens(ends_a, x, y), tokens(ends_b, x, y)) for x, y in zip(shared, shared[1:])]


ends = st.sets(st.integers(1, 60), max_size=40).map(lambda s: sorted(s | {60}))


@given(ends_a=ends, ends_b=ends)
def test_groups_are_those_between_shared_ends(ends_a, ends_b):
    found = token_alignment.shared_groups(ends_a, ends_b)
    assert [(list(range(a, b)), list(range(c, d))) for a, b, c, d in found] == cuts(ends_a, ends_b)


def test_cutless_and_lopsided_intervals():
    odd, even = list(range(1, 4001, 2)) + [4002], list(range(2, 4003, 2))
    assert token_alignment.shared_groups(odd, even) == [(0, len(odd), 0, len(even))]
    late = [*odd[:-1], *range(4002, 8000)], [*even, *range(4003, 8000)]
    assert len(token_alignment.shared_groups(*late)) == 7999 - 4001
    assert token_alignment.shared_groups([], []) == []


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    import tokenizers
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, tokenizers):
    a, b = tokenizers
    direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in direct]
    letter = {chr(k): k for k in direct} | {chr(256 + i): k for i, k in enumerate(rest)}
    docs = []
    for doc, text in rows:
        ids_a = ids_b = groups = ()
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            of_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
            pieces = [b.id_to_piece(i) for i in ids_b]
            of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                at = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
                groups = [([ids_a[k] for k in x], [ids_b[k] for k in y]) for x, y in cuts(at(of_a), at(of_b))]
            else:
                ids_a = ids_b = ()
        docs.append((doc, ids_a, ids_b, groups, Counter((x, y) for g, h in groups for x in g for y in h)))
    count = Counter(pair for *_, links in docs for pair in links)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    said = lambda groups: ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
    return [(doc, len(x), len(y), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == highest[p[0]]),
             sum(n * count[p] for p, n in links.items()), hashlib.sha256(said(groups).encode()).hexdigest() if groups else "")
            for doc, x, y, groups, links in docs]


def corpus(spark):
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts = [t if t is None else t[:1500] for t in texts]
    odd = [None, "", " ", "  ", "\n", "foo ", " foo", "foo  bar", "foo\n  bar \t baz\n", "tabs\t\tand \n \n lines\r\n", "a<|endoftext|>b <s> </s><unk> <0x41>",
           "a▁b ▁ c", "ü漢字 🙂🙂 　x  y", "don't we'll  they 've", "x" * 400, " " * 50, "#### $$$ ...!!! ((((", "é \x85 \x1c end", "\0 nul \x7f",
           "ﬁ ２ Å", "ab" * 300 + " " * 33 + "1234567890" * 30]
    parts = [" ", "  ", "\n", "a", "word", ".", "é", "漢", "\t", "12", "'s", " ", "▁x"]
    mixed = ["".join(rng.choices(parts[:-1], k=30)) for _ in range(60)] + ["".join(rng.choices(parts, k=8)) for _ in range(20)]
    rows = list(enumerate(texts + odd + mixed))
    return [*rows, (3, rows[3][1]), (3, rows[3][1]), (None, "no id"), (4, "other text of an id")]


def test_op13_query_against_brute_force(spark, folder_of, documents, tokenizers):
    rows = corpus(spark)
    docs = documents([(i, t, "s") for i, t in rows]).repartition(3)
    docs = docs.withColumn("block", docs["lang"]).withColumn("pair", docs["lang"]).withColumn("n_a", docs["text"])
    found = QUERIES["op13_shared_cuts"](spark, folder_of(documents=docs))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(brute(rows, tokenizers), key=str)


def test_small_blocks_and_real_groups(documents):
    docs = documents([(i, t, "s") for i, t in enumerate(["one two", "one  three", None, "two one", "", "one two"] * 5)])
    found = [{tuple(r) for r in token_alignment.align_tokens(docs, A, B, block_chars=c).collect()} for c in (1, 12, 10_000)]
    assert found[0] == found[1] == found[2]
    groups = {r[0]: r[-1] for r in found[0]}
    assert groups[2] == "" and groups[0] == groups[5] and groups[0].count(";") == 1 and "|" in groups[0]


def test_forgetting_changes_nothing(tokenizers):
    texts = [f"word{k} and {k} words" for k in range(300)]
    small, large = token_alignment.Aligner(A, B, limit=10), token_alignment.Aligner(A, B)
    groups = lambda aligner, some: [[aligner.groups[e] for e in found] for found in aligner.entries(some)]
    assert [g for k in range(0, 300, 20) for g in groups(small, texts[k:k + 20])] == groups(large, texts)


def test_tables_without_tokens(documents):
    assert token_alignment.align_tokens(documents([]), A, B).count() == 0
    found = token_alignment.align_tokens(documents([(1, None, "s"), (2, "", "s"), (3, "▁", "s")]), A, B).collect()
    assert sorted(tuple(r) for r in found) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
