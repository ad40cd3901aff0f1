import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from keepsake.llm import token_files
from keepsake.llm.queries import QUERIES
from keepsake.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "one", "one two", " lead", "trail ", "two  spaces", "tab\t x\n y", "it's we'll <|endoftext|> end",
         "né  ü   x", "a" * 3000, "12 345,67 $% --", "\n\n a\n\n", "x \ty", "漢字 かな 🙂 🙂", "x² ½ ª\xa0y\x85 \x1c z_", "Ünï’s I'LL they're"]


def test_pretokens_give_the_ids_of_the_whole_text():
    whole = Tokenizer.from_file(PATH)
    encoder = token_files.PretokenEncoder(PATH, public_tokenizers.PATTERN, limit=3)
    for _ in range(2):
        for text, found in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(found, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def brute(rows):
    whole, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_op1_query_against_whole_texts(spark, folder_of, documents):
    rows = [(40 - i, t) for i, t in enumerate(TEXTS)] + [(99, None), (100, "long " * 30_000)]
    folder = folder_of(documents=documents([(i, t, "s") for i, t in rows]).repartition(5))
    found = [tuple(r)[:4] for r in QUERIES["op1_token_orc"](spark, folder).collect()]
    assert sorted(found) == brute(rows)


def test_repeated_and_null_ids(spark, documents):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(documents([(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s"), (None, "d", "s")]), path, PATH, public_tokenizers.PATTERN)
    found = token_files.token_digests(spark, path).collect()
    assert len(found) == 4
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert max(found, key=lambda r: r["start"])["doc_id"] is None


def test_empty_table_and_extra_columns(spark, documents):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(documents([]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "part"), path, PATH, public_tokenizers.PATTERN)
    assert token_files.token_digests(spark, path).count() == 0


def test_files_have_stripes_indexes_and_pruned_reads(spark, documents):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(documents([(i, f"text number {i} of many", "s") for i in range(9000)]), path, PATH, public_tokenizers.PATTERN,
                             stripe_bytes=4096, row_index_stride=1000)
    files = spark.read.orc(path).inputFiles()
    assert any(orc.ORCFile(f.removeprefix("file://")).nstripes > 1 for f in files)
    one = token_files.read_tokens(spark, path).where("doc_id = 1234")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
